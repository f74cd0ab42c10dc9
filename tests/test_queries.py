"""Registered queries against their SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from seqloom.plans import io_queries, kmer_queries, registry, relation_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_logit_fits_every_word(spark):
    words = relation_queries.word_docs(spark, DATA).select("kmer").collect()
    assert sorted(r.key for r in relation_queries.logit_association(spark, DATA).select("key").collect()) == sorted(r.kmer for r in words)


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kmer", "n"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
