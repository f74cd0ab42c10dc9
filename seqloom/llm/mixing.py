"""Mixing sources to target weights along a time-varying curriculum.

Sources weigh 1, 2, 3, repeating, in the order of their names, and share all words; no source gives more
than three times what it has, and what is over is shared anew by weight. Each source's weight follows a
schedule over training time; its integral is the source's cumulative demand for words. A source's
documents, in hash order and again for each repeat, lie on that demand: a copy whose middle word is
demanded at time t is trained on at position t. Copies that lie beyond the whole demand aren't taken.

Null and empty texts have size 0 and give no words; null sources are one source, last in order; rows without
id are ordered by their text. Repeated rows are rows of their own, each with its copies; the order of equal
ids is by size, so reruns agree. An empty table gives no rows. Very long texts are only counted. Columns not
named in `carry` are left out, and the names of those that are mustn't be result columns. Running sums go by
hash ranges of about RANGE_ROWS rows, so that a hot source is spread over many tasks; sources, of which a
window holds one row each, are taken to be few (as names are, not documents).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .labelled import key_hash

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
RANGE_ROWS = 2000
#: Weight over time, as (time, relative weight) knots, for each of WEIGHTS: light sources fade, heavy ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))
#: A word, in the pattern language of the engine.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """One row per source: source_size, source_rows, class (index of its weight) and target.

    A source stops at its cap when the level that the rest would get, with all sources of a smaller
    cap to weight ratio stopped, is above its own ratio. One task sees one row per source.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    kind = ((F.row_number().over(order) - 1) % len(weights)).alias("class")
    level = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1)
    one = stats.select("*", kind).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    two = one.withColumns({
        "total": F.sum(F.col("source_size").cast("double")).over(whole),
        "all_weight": F.sum("weight").over(whole),
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    three = two.withColumn("stopped", (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("gone")) > F.col("ratio"))
    four = three.withColumns({
        "kept_caps": F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(whole),
        "open_weight": F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(whole),
    })
    share = F.col("weight") * ((F.col("total") - F.col("kept_caps")) / F.col("open_weight"))
    return four.select("source", "source_size", "source_rows", "class", F.when(F.col("stopped"), F.col("cap")).otherwise(share).alias("target"))


def demand_time(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source of this class has demanded `share` (0 to 1) of its words.

    Between knots the weight is linear, so the integral is quadratic and is inverted in closed form.
    """
    out = share
    for index, knots in reversed(list(enumerate(schedules))):
        parts, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area = (w0 + w1) / 2 * (t1 - t0)
            parts.append((t0, w0, (w1 - w0) / (t1 - t0), total, total + area))
            total += area
        time = F.lit(1.0)
        for t0, w0, slope, low, high in reversed(parts):
            need = share * total - low
            root = need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - w0) / slope
            time = F.when(share * total <= high, root + t0).otherwise(time)
        out = F.when(kind == index, time).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def assign(docs: DataFrame, range_rows: int = RANGE_ROWS, schedules=SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and positions (training time of each copy) for every row.

    `carry` columns of docs pass unchanged.
    """
    scratch = Scratch(docs.sparkSession)
    key = key_hash(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))
    sized = scratch.cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("h"), *carry))
    targets = scratch.cut(source_targets(sized), 1)  # one task's few rows
    ranges = F.ceil(F.col("source_rows") / range_rows)
    known = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.withColumn("r", F.floor(F.col("h") / float(1 << 60) * ranges).cast("long"))
    sums = known.groupBy("source", "r").agg(F.sum("size").alias("range_size"))
    ahead = sums.select(F.col("source").alias("s"), F.col("r").alias("q"), F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = known.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("r") == F.col("q"))).drop("s", "q")
    inner = W.partitionBy("source", "r").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    placed = placed.withColumn("offset", offset)
    middles = F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda k: k * F.col("source_size") + (F.col("offset") + F.col("size") / 2.0))
    inside = F.filter(middles, lambda m: m < F.col("target"))
    positions = F.transform(inside, lambda m: demand_time(m / F.col("target"), F.col("class"), schedules))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size(inside)).alias("taken"), positions.alias("positions"), *carry)


def curriculum(docs: DataFrame, range_rows: int = RANGE_ROWS, schedules=SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """One row per taken copy with its training position, range-sorted by position."""
    copies = assign(docs, range_rows, schedules, carry).select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.orderBy("position", "doc_id", "copy")


def training_order(docs: DataFrame, range_rows: int = RANGE_ROWS, schedules=SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of assign(), range-sorted by the training positions of their copies; rows that aren't taken come last."""
    return assign(docs, range_rows, schedules, carry).orderBy(F.size("positions") == 0, "positions", "doc_id", "size")


def demand_sql(share: str, kind: str, schedules=SCHEDULES) -> str:
    """demand_time as SQL text."""
    number = lambda x: f"{x!r}::DOUBLE"
    out = share
    for index, knots in reversed(list(enumerate(schedules))):
        parts, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area = (w0 + w1) / 2 * (t1 - t0)
            parts.append((t0, w0, (w1 - w0) / (t1 - t0), total, total + area))
            total += area
        time = "1.0::DOUBLE"
        for t0, w0, slope, low, high in reversed(parts):
            need = f"({share} * {number(total)} - {number(low)})"
            root = f"{need} / {number(w0)}" if slope == 0 else f"(sqrt(greatest({number(w0 * w0)} + {number(2 * slope)} * {need}, 0)) - {number(w0)}) / {number(slope)}"
            time = f"CASE WHEN {share} * {number(total)} <= {number(high)} THEN {root} + {number(t0)} ELSE {time} END"
        out = f"CASE WHEN {kind} = {index} THEN {time} ELSE {out} END"
    return f"greatest(0, least(1, {out}))"


#: The same rows in DuckDB: sizes, targets by the same closed form, and running sums in hash order.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
stats AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
one AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM stats),
two AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio,
         sum(source_size::DOUBLE) OVER () AS total, sum(weight) OVER () AS all_weight FROM one),
three AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) > ratio AS stopped
  FROM two WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
four AS (
  SELECT *, sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER () AS kept_caps,
         sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open_weight FROM three),
targets AS (
  SELECT source, source_size, class, CASE WHEN stopped THEN cap ELSE weight * ((total - kept_caps) / open_weight) END AS target FROM four),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.class,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, before + size / 2.0::DOUBLE AS middle, (before + size / 2.0::DOUBLE < target)::BIGINT + (source_size + before + size / 2.0::DOUBLE < target)::BIGINT
              + (2 * source_size + before + size / 2.0::DOUBLE < target)::BIGINT AS n_copies
  FROM placed)
SELECT doc_id, size, source_size, target, (size * n_copies)::BIGINT AS taken, n_copies,
       CASE WHEN n_copies > 0 THEN round({demand_sql('(middle / target)', 'class')}, 9) END AS first_position,
       CASE WHEN n_copies > 0 THEN round({demand_sql('(((n_copies - 1) * source_size + middle) / target)', 'class')}, 9) END AS last_position
FROM counted"""
