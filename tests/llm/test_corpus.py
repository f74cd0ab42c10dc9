"""Corpus operators against brute force, exact round trips and held-out labels, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import bpe, line_dedup, media_gif, mixing, ngram_join, pii, quality_gam, quality_rules, queries, text_kernel, token_counts, url_filters
from seqloom.llm.common import flat_bytes, tokenizer_path
from seqloom.llm.labelled import held_out

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(r, n):
    return " ".join("".join(r.choice("aeiourstlnm") for _ in range(r.randrange(1, 9))) for _ in range(n))


def awkward(seed=0, n=40):
    """Texts with nulls, empties, repeats, near copies and a long one."""
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "a", "One two", "x " * 3000, "É ü\x1c ñ 你好 😀 <|endoftext|> it's 12 ²", sentence(r, 4000)]
    for _ in range(n):
        w = sentence(r, r.randrange(3, 120)).split()
        texts.append(" ".join(w))
        if r.random() < 0.5:
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = "zz"
            texts.append(" ".join(v).upper() if r.random() < 0.3 else " ".join(v))
    return texts + texts[8:12]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None) for i, t in enumerate(awkward())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def rough(spark, docs):
    """The same with repeated rows, a null id, and columns that clash with the operators' own."""
    again = docs.where("doc_id in (9, 10)")
    null = spark.createDataFrame([(None, "no id at all", "en", "s1", 3)], DOCS)
    out = docs.union(again).union(null)
    for c in ("id", "size", "score", "node", "version", "spans", "key", "target", "ids", "media", "h", "c0"):
        out = out.withColumn(c, F.lit("x"))
    return out


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- text kernel -------------------------------------------------------------------------------------


def test_text_stats_match_brute_force():
    r = random.Random(3)
    texts = [t or "" for t in awkward(1)] + ["".join(r.choice("ab \n") for _ in range(r.randrange(80))) for _ in range(300)]
    data, offsets = flat_bytes(pa.array(texts))
    s = text_kernel.text_stats(data, offsets)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(set(w)))
        assert tuple(int(s[k][i]) for k in ("words", "word_chars", "symbol", "dup_lines", "repeat_words", "distinct_words")) == want


def shingle_set(t, k=5):
    w = [x.translate(LOWER) for x in WORD.findall(t or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


# --- 1: URL filters -----------------------------------------------------------------------------------


def brute_rule(host, path):
    best = None
    for what, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return best


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "https://a.example.org/es/1?x=1", ""),
        (2, "http://mirror.net/p", link.format("https://a.example.org/es/1?x=1")),
        (3, "http://third.net/q", '<META http-equiv="refresh" content="0; url=http://mirror.net/p">'),
        (4, "HTTP://Sub.ORG/ok", link.format("http://mirror.net/p")),
        (5, None, None), (6, "no scheme", ""), (7, "http://com", ""), (8, "http://x.com/de/y#z", None), (9, "https://www.x.com/de/y", ""),
        (10, "http://x.com/fr/a", link.format("/de/y")), (11, "http://plain.net/a/b", link.format("c")), (11, "http://plain.net/a/b", ""),
        (12, "http://example.org/en/12", ""), (13, "http://m.safe.net/x/?utm_source=f", ""), (14, "http://safe.net/x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("node", F.lit(1))
    out = url_filters.judge(df, queries.URL_RULES, conventions=True)
    got = table(out, "page_id")
    assert out.count() == len(pages)
    assert (got[4].host, got[4].path, got[5].host, got[6].path, got[7].path) == ("sub.org", "/ok", "", "", "")
    for i, r in got.items():
        rule = brute_rule(r.host, r.path)
        assert r.rule == (rule[1] if rule else None)
        if rule:
            assert r.verdict == rule[0]
    verdicts = {i: r.verdict for i, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "block", 13: "allow", 14: "allow"}
    assert got[13].alias_class == got[14].alias_class is not None
    many = [*queries.URL_RULES, *[("block", f"h{i}.net", "/") for i in range(100)]]
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, many, conventions=True).collect()} == {i: (r.rule, r.verdict) for i, r in got.items()}
    assert url_filters.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_blocked_targets_that_are_no_pages(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.net/1", link.format("https://x.com/de/y#top")), (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'),
        (3, "http://ok.org/3", link.format("http://a.net/1")), (4, "http://c.net/4", link.format("https://x.com/fr/y")), (5, "http://d.net/5", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    many = [*queries.URL_RULES, *[("block", f"h{i}.net", "/") for i in range(100)]]
    for rules in (queries.URL_RULES, many):
        assert {r.page_id: r.verdict for r in url_filters.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_links_of_a_page():
    text = """<link rel="stylesheet" href=a><LINK data-x='%s' href='/b?x=1&amp;y=2' rel="alternate CANONICAL"><!-- <link rel=canonical href=c> -->
    <script>var t = '<link rel=canonical href=d>';</script><meta content="5; URL = 'e f'" http-equiv=Refresh><link rel=canonical href=g/><meta name=refresh content="0; url=h">
    <link rel=canonical href="" ><link rel=canonical><title><link rel=canonical href=i></title><link rel=canonical href="j""" % ("z" * 5000)
    assert url_filters.named_addresses(text) == ["/b?x=1&y=2", "e f", "g/"]
    for t in ("<link " * 50_000, "<!--" * 50_000, "<link a='" * 50_000, "<link rel=canonical href=" + "x" * 1_000_000 + ">", "<script>" * 20_000):
        url_filters.named_addresses(t)


def test_blocks_spread_as_in_sql_and_by_brute_force(spark, tmp_path):
    r = random.Random(12)
    hosts = ["x.com", "y.org", "z.net", "w.net", "v.net"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['de', 'fr', 'q'])}/{i}" for i in range(120)] + [f"http://only.com/de/{i}" for i in range(3)]
    pages, edges = [], []
    for i, u in enumerate(urls[:120]):
        body = ""
        for t in r.sample(urls, r.choice([0, 0, 1, 1, 2])) + ([urls[7]] if i % 9 == 0 else []):  # chains, loops and a hub
            body += r.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">']).format(t)
            edges.append((u, t))
        pages.append((i, u, body))
    pages += [pages[3], (500, None, body), (501, "no address", body), (502, "http://alone.net", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")

    def rule(u):
        host, _, path = u.split("://")[1].partition("/")
        return brute_rule(host, "/" + path)

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    bad, todo = set(), [u for u in urls if (x := rule(u)) and x[0] == "block"]
    while todo:
        if (u := todo.pop()) not in bad:
            bad.add(u)
            todo += near[u]
    want = {i: ((rule(u)[0] if rule(u) else "block" if u in bad else "allow") if u and "://" in u else "allow") for i, u, _ in pages}
    got = url_filters.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(pages) and {r.page_id: r.verdict for r in got} == want and set(want.values()) == {"allow", "block"}
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    mine = queries.op1_url_filters(spark, str(tmp_path))
    names = mine.columns
    cursor = con.execute(queries.ORACLE_SQL["op1_url_filters"])
    order = [[c[0] for c in cursor.description].index(n) for n in names]
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(str(tuple(x[k] for k in order)) for x in cursor.fetchall())


# --- 2: GIF -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 256, 3837, 3838, 3839, 70000])
def test_lzw_round_trips(n):
    r = random.Random(n)
    for data in (bytes(n), bytes(r.randrange(256) for _ in range(n)), (b"abcabd" * n)[:n]):
        assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n) == data
        assert media_gif.lzw_decode(media_gif.literal_encode(data), 8, n) == data
    small = bytes(r.randrange(4) for _ in range(n))
    assert media_gif.lzw_decode(media_gif.lzw_encode(small, 2), 2, n) == small


def gif(frames, width, height, colours):
    """A GIF from (left, top, w, h, samples, disposal, transparent index or None, delay)."""
    out = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([0x81, 0, 0]) + bytes(colours)
    for x, y, w, h, s, disposal, clear, delay in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + b"\0\x02" + media_gif.blocks(media_gif.lzw_encode(bytes(s), 2))
    return out + b"\x3b"


def test_gif_disposal_transparency_and_time():
    colours = [10, 0, 0, 0, 20, 0, 0, 0, 30, 9, 9, 9]
    data = gif([(0, 0, 2, 2, [0, 1, 2, 3], 1, None, 5), (0, 0, 1, 1, [3], 3, None, 7), (1, 1, 1, 1, [0], 2, 0, 1), (0, 1, 1, 1, [1], 0, None, 2)], 2, 2, colours)
    f = list(media_gif.read_gif(data))
    rgb = lambda k: f[k].canvas[..., :3].tolist()
    first = [[[10, 0, 0], [0, 20, 0]], [[0, 0, 30], [9, 9, 9]]]
    assert rgb(0) == first and rgb(1)[0][0] == [9, 9, 9]
    assert rgb(2) == first  # the frame before was undone, and this one is all transparent
    assert f[3].canvas[1, 1].tolist() == [0, 0, 0, 0] and rgb(3)[1][0] == [0, 20, 0]
    assert [(x.start, x.delay) for x in f] == [(0, 5), (5, 7), (12, 1), (13, 2)]
    assert sum(media_gif.histogram(f[3].canvas, 8)[1]) == 3  # the clear pixel isn't counted


def test_gif_query_and_faults(spark, rough):
    stored = media_gif.encode_texts(rough)
    back = media_gif.decode(stored, carry=("n_bytes",))
    for r in back.collect():
        assert r.error is None and len(r.frames) == 1 and sum(r.frames[0].red) == r.frames[0].width * r.frames[0].height
    broken = stored.withColumn("media", F.expr("substring(media, 1, length(media) - 20)"))
    assert all(r.error for r in media_gif.decode(broken).collect())
    none = stored.withColumn("media", F.lit(None).cast("binary"))
    assert all(r.frames == [] and r.error is None for r in media_gif.decode(none).collect())
    two = media_gif.encode_gif(bytes(64 * 5), frame_rows=2, compress=True)
    assert [f.height for f in media_gif.read_gif(two)] == [2, 2, 1]
    assert media_gif.decode(media_gif.encode_texts(rough.limit(0))).count() == 0


def test_gif_contract(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r, t in zip(queries.op2_media_gif(spark, str(tmp_path)).orderBy("doc_id").collect(), awkward()):
        raw = (t or "").encode()
        payload = raw.ljust(64 * max(1, -(-len(raw) // 64)), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# --- 3: token counts ----------------------------------------------------------------------------------


def test_token_counts_match_viterbi(spark, rough):
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        counter = token_counts.Counter(f.read(), open(tokenizer_path(), encoding="utf-8").read())
    cost = counter.trie.cost

    def brute(word):
        best = [(0, 0)] + [None] * len(word)
        for d in range(1, len(word) + 1):
            best[d] = min((best[k][0] + cost[word[k:d]], best[k][1] + 1) for k in range(d) if word[k:d] in cost)
        return best[-1][1]

    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(3000))
    assert counter.trie.alone(long.encode()) == brute(long.encode()) == counter.count(long)[1]
    huge = long * 350
    assert counter.count(huge)[0] == 1 and len(counter.trie.best) < 10_000 and not counter.terminal
    texts = [r.text or "" for r in rough.collect()]
    for t in texts:
        words = counter.vocabulary.words(t)
        assert "".join(words) == t
        assert counter.count(t) == (len(words), sum(brute(w.encode()) for w in words))
    assert token_counts.token_counts(rough).count() == rough.count()
    assert token_counts.token_counts(rough.limit(0)).count() == 0


# --- 4: mixing ----------------------------------------------------------------------------------------


def test_mixing_matches_sql_and_targets(spark, docs):
    rows = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    for width in (2, 2000):
        got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.assign(docs, width).collect()}
        assert set(got) == set(want)
        for k in got:
            assert got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) and got[k][3] == want[k][3]
            assert got[k][3] <= 3 * got[k][0]
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in set(source.values()):
        own = [k for k in got if source[k] == s]
        assert abs(sum(got[k][3] for k in own) - got[own[0]][2]) <= max(got[k][0] for k in own)


def test_water_level_is_iterated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 40, "d": 5, None: 300}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(target)


def test_curriculum_order_and_schedules(spark, rough):
    rows = mixing.curriculum(rough).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert sum(r.size for r in rows) == sum(r.taken for r in mixing.assign(rough).collect())
    knots = ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75))
    grid = np.linspace(0, 1, 100001)
    w = np.interp(grid, *zip(*knots))
    cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    cum /= cum[-1]
    df = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 11)], "c double")
    for r in df.select("c", mixing.demand_time(F.col("c"), F.lit(2)).alias("t")).collect():
        assert np.interp(r.t, grid, cum) == pytest.approx(r.c, abs=1e-6)
    assert mixing.assign(rough.limit(0)).count() == 0


def test_registered_mixing_follows_the_schedules(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = {r.doc_id: r.positions for r in mixing.assign(docs).collect()}
    mixed = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in mixed] == sorted(at, key=lambda d: (not at[d], at[d], d))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    for r in mixed:
        assert tuple(r)[1:3] == want[r.doc_id][:2] and tuple(r)[4:6] == want[r.doc_id][3:5]
        assert tuple(r)[6:] == pytest.approx(want[r.doc_id][5:], abs=1e-9) and len(at[r.doc_id]) == r.n_copies
    copies = queries.curriculum_copies(spark, str(tmp_path)).collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    assert sorted((r.doc_id, r.copy, r.position) for r in copies) == sorted((d, k, x) for d, p in at.items() for k, x in enumerate(p))
    assert "SQRT" in queries.op4_mixing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


# --- 5: line removal ----------------------------------------------------------------------------------


def test_repeated_lines_and_passages(spark):
    r = random.Random(7)
    passage = " ".join(sentence(r, 8).capitalize() + "." for _ in range(9))
    own = [sentence(r, 16).capitalize() + "." for _ in range(8)]
    texts = [
        f"{own[0]} {passage}\n{own[1]}", f"{own[2]} half of {passage} {own[3]}", f"{own[4]}\nThis line is shared by two {own[4]}\n{own[5]}", f"{own[6]}\nthis LINE is shared  by two {own[4]}", "Yes.\nNo.", "Yes.\nNo.", None, "",
        f"{own[7]}\n{own[7]}",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string").withColumn("digest", F.lit(0))
    spans = line_dedup.repeated_spans(df).collect()
    cut = {(s.doc_id, texts[s.doc_id][s.start : s.stop]) for s in spans}
    assert {d for d, _ in cut} == {1, 3, 8}
    assert {s.doc_id: s.kept_doc_id for s in spans} == {1: 0, 3: 2, 8: 8}
    assert passage.split(". ", 1)[1] in "".join(t for d, t in cut if d == 1)
    assert (3, f"this LINE is shared  by two {own[4]}") in cut
    kept = {r.doc_id: r.text for r in line_dedup.remove_spans(df, line_dedup.repeated_spans(df)).collect()}
    assert kept[0] == texts[0] and "LINE" not in kept[3] and kept[8].count(own[7]) == 1 and kept[6] is None
    assert line_dedup.repeated_spans(df.limit(0)).count() == 0


def test_repeated_rows_with_short_sentences(spark):
    r = random.Random(9)
    passage = " ".join(sentence(r, 3).capitalize() + "." for _ in range(8))
    rows = [(0, f"{sentence(r, 9)}. {passage}"), (1, f"{sentence(r, 9)}. {passage} {sentence(r, 9)}.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = line_dedup.repeated_spans(df).collect()
    assert [(s.doc_id, s.kept_doc_id, s.n_words) for s in want] == [(1, 0, 24)] and rows[1][1][want[0].start : want[0].stop] == passage
    assert line_dedup.repeated_spans(df.union(df).union(df.where("doc_id = 1"))).collect() == want


def test_passages_without_sentence_ends(spark):
    r = random.Random(10)
    for _ in range(3):
        passage = sentence(r, 60)
        texts = [f"{sentence(r, 20)} {passage} {sentence(r, 20)}", f"{sentence(r, 30)} {passage} {sentence(r, 7)}", sentence(r, 90)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        spans = line_dedup.repeated_spans(df).collect()
        assert {s.doc_id for s in spans} == {1} and all(texts[1][s.start : s.stop] in passage for s in spans)
        assert sum(s.n_words for s in spans) >= 30 and all(len(texts[1][s.start : s.stop].split()) == s.n_words for s in spans)


def brute_spans_of_repeats(rows, run_words=line_dedup.RUN_WORDS):
    """Spans by plain loops over the units of the distinct rows."""
    rows = sorted(set((d, t) for d, t in rows if t))
    data, offsets = flat_bytes(pa.array([t for _, t in rows], pa.string()))
    u = line_dedup.units(data, offsets)
    each = [dict(zip(u, (x.item() for x in v))) for v in zip(*u.values())]
    first = {}
    for x in sorted(each, key=lambda x: (rows[x["row"]][0], x["row"], x["start"])):
        first.setdefault((x["digest"], x["kind"]), x)
    found = collections.defaultdict(list)
    runs = collections.defaultdict(list)
    for x in sorted(each, key=lambda x: (x["row"], x["kind"], x["number"])):
        f = first[x["digest"], x["kind"]]
        if f is not x:
            last = runs[x["row"], x["kind"]]
            if x["kind"] != line_dedup.LINE and last and last[-1][-1][0]["number"] + 1 == x["number"]:
                last[-1].append((x, f))
            else:
                last.append([(x, f)])
    for (row, kind), several in runs.items():
        for run in several:
            if kind == line_dedup.LINE or run[-1][0]["place"] + run[-1][0]["words"] - run[0][0]["place"] >= run_words:
                found[row].append((run[0][0]["start"], max(x["end"] for x, _ in run), run[0][0]["place"], max(x["place"] + x["words"] for x, _ in run), min(rows[f["row"]][0] for _, f in run)))
    out = []
    for row, spans in found.items():
        joined = []
        for s in sorted(spans):
            if joined and s[0] <= joined[-1][1]:
                j = joined[-1]
                joined[-1] = (j[0], max(j[1], s[1]), j[2], max(j[3], s[3]), min(j[4], s[4]))
            else:
                joined.append(s)
        out += [(rows[row][0], a, b, q - p, k) for a, b, p, q, k in joined]
    return sorted(out)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_repeats_match_brute_force(spark, kind):
    r = random.Random(17)
    pool = [sentence(r, r.choice([3, 6, 17, 30])).capitalize() + r.choice([".", "!", ""]) for _ in range(30)]
    rows = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.5 else sentence(r, r.randrange(1, 20)) for _ in range(r.randrange(1, 9))]
        text = "".join(p + r.choice([" ", "\n", "  ", "\n\n"]) for p in parts)
        rows.append((f"{i:03}" if kind == "string" else i, text))
    rows += [(rows[0][0], None), (rows[1][0], ""), (rows[2][0], " \n"), (rows[3][0], "another text of this id")]
    df = spark.createDataFrame(rows + rows[5:20] + rows[5:9], f"doc_id {kind}, text string").repartition(3)
    for c in ("digest", "version", "start", "stop", "kept", "place", "kind", "number"):
        df = df.withColumn(c, F.lit("x"))
    spans = line_dedup.repeated_spans(df)
    got = sorted((s.doc_id, s.start, s.stop, s.n_words, s.kept_doc_id) for s in spans.collect())
    assert got == brute_spans_of_repeats(rows) and len(got) > 20
    text = dict(rows[:60])
    left = {}
    for d, a, b, *_ in sorted(got, key=lambda s: -s[1]):
        left[d] = left.get(d, text[d])[:a] + left.get(d, text[d])[b:]
    clean = line_dedup.remove_spans(df, spans)
    assert clean.columns == df.columns and clean.count() == df.count()
    for row in clean.where("length(text) > 23").collect():
        assert row.text == left.get(row.doc_id, text[row.doc_id])


def test_finer_units_can_be_left_out(spark):
    r = random.Random(18)
    line, passage = sentence(r, 20), sentence(r, 60)
    rows = [(0, f"{line}\n{sentence(r, 5)} {passage}"), (1, f"{sentence(r, 6)}\n{line}"), (2, f"{sentence(r, 4)} {passage} {sentence(r, 4)}"), (3, "short line\n" + sentence(r, 30)), (4, "short line\n" + sentence(r, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {s.doc_id for s in line_dedup.repeated_spans(df).collect()} == {1, 2}
    assert {s.doc_id for s in line_dedup.repeated_spans(df, sentences=False, chunks=False).collect()} == {1}
    assert {s.doc_id for s in line_dedup.repeated_spans(df, line_words=2, sentences=False, chunks=False).collect()} == {1, 4}


# --- 6 and 7: quality ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = sentence(r, r.randrange(30, 120)).split()
        if not good:
            w = [x + "###" if r.random() < 0.5 else x.upper() for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        if r.random() < 0.8:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")


def accuracy(scores, labels):
    truth = {r.doc_id: r.quality for r in labels.dropna().collect()}
    return np.mean([scores[k] == truth[k] for k in truth if k in scores])


def test_quality_rules(spark, labelled, rough):
    docs, labels = labelled
    model = quality_rules.fit(docs, labels)
    out = table(quality_rules.score(docs, model))
    assert accuracy({k: int(r.kept) for k, r in out.items()}, labels) > 0.95
    odd = quality_rules.score(rough, model)
    assert odd.count() == rough.count()
    for r in odd.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) and 0 <= r.probability <= 1
    none = quality_rules.fit(docs, labels.limit(0))
    assert all(r.kept or r.base_failed for r in quality_rules.score(docs, none).collect())
    assert quality_rules.score(docs.limit(0), model).count() == 0


def test_additive_model(spark, labelled, rough):
    docs, labels = labelled
    model = quality_gam.fit(docs, labels, keep=~held_out(F.col("doc_id")))
    apart = docs.where(held_out(F.col("doc_id")))
    scored = quality_gam.score(apart, model)
    assert scored.columns == [*docs.columns, "score"]
    assert accuracy({r.doc_id: int(r.score >= 0.3) for r in scored.collect()}, labels) > 0.95
    again = quality_gam.fit(docs.repartition(7), labels.repartition(3), keep=~held_out(F.col("doc_id")))
    assert table(quality_gam.score(apart, again)) == table(scored)
    odd = quality_gam.score(rough, model)
    assert odd.columns[-1] == "quality_score" and odd.count() == rough.count() and all(0 <= r.quality_score <= 1 for r in odd.collect())
    assert {round(r.score, 6) for r in quality_gam.score(docs, quality_gam.fit(docs, labels.limit(0))).collect()} == {1.0}


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# --- 8: n-gram join -----------------------------------------------------------------------------------


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def near_copies(seed, groups=12, size=14):
    """Chains, hubs and decoys at all distances round the threshold, with a common passage."""
    r = random.Random(seed)
    passage = sentence(r, 40)
    texts = []
    for _ in range(groups):
        base = sentence(r, r.choice([4, 6, 12, 30, 60, 150, 400])).split()
        if r.random() < 0.5:
            base += passage.split()
        last = base
        for _ in range(size):
            v = list(last if r.random() < 0.4 else base)
            for _ in range(r.randrange(0, max(2, len(v) // 20))):
                at = r.randrange(len(v))
                v[at : at + 1] = [sentence(r, 1)] * r.choice([0, 1, 1, 2])
            texts.append(" ".join(v))
            last = v
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    texts = near_copies(seed) + awkward(seed)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("node", F.lit(1))
    got = ngram_join.similar_components(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingle_set(t)) for d, t in rows}


def test_join_levels_blocks_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ngram_join, "HELD_KEYS", 50)
    rows = list(enumerate(near_copies(5, 8)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(df).collect()} == brute_components(rows)


def test_every_link_shares_a_key():
    texts = near_copies(9, 20)
    value, row = text_kernel.shingles(*flat_bytes(pa.array(texts)))
    size, node, _ = ngram_join.set_hashes(value, row, len(texts))
    frequent = np.unique(value)[::3]
    for rare in (np.zeros(0, np.uint64), frequent):
        key, owner, _, _ = ngram_join.join_keys(value, row, size, rare)
        keys = [set(key[owner == i].tolist()) for i in range(len(texts))]
        sets = [shingle_set(t) for t in texts]
        sketch = ngram_join.bit_sketches(value, row, size)
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and node[i] != node[j]:
                    assert keys[i] & keys[j]
                    a, b = sorted((np.frombuffer(sketch[k], "<u8")[None] for k in (i, j)), key=lambda x: x.shape[1])
                    assert int(np.bitwise_count(a ^ ngram_join.fold(b, a.shape[1])).sum()) <= len(sets[i] ^ sets[j])


def test_keys_that_meet_by_chance_lose_no_link(spark, monkeypatch):
    """Keys of 8 bits: those of different sets, and those of one set, are often equal."""
    monkeypatch.setattr(ngram_join, "KEY_BITS", 4)
    rows = list(enumerate(near_copies(6, 8)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(df).collect()} == brute_components(rows)


def test_bytes_of_a_sent_key(spark):
    """F1: a key took 20 bytes, as size and parts of its set went with it; now 12. Compressed, here: 13.4 before, 9.1 now."""
    r = random.Random(3)
    texts = [sentence(r, r.randrange(20, 120)) for _ in range(1500)]
    value, row = text_kernel.shingles(*flat_bytes(pa.array(texts)))
    size, node, _ = ngram_join.set_hashes(value, row, len(texts))
    key, owner, kind, parts = ngram_join.join_keys(value, row, size, ngram_join.NONE)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0] + " more"]], "text string").coalesce(1)
    before = sent()
    got = ngram_join.shared_keys(df, ngram_join.NONE, ngram_join.NONE, 4).collect()
    assert sent() - before < 11 * len(key)
    assert {(r.node, r.kind, r.size, r.parts) for r in got if r.key is None} >= set(zip(node[owner].tolist(), kind.tolist(), size[owner].tolist(), parts.tolist()))
    assert node[0] in {r.node for r in got if r.key is not None and r.many == 2}


def test_keys_of_the_same_nodes_meet_once(spark):
    """every key of a pair dealt both sketches anew."""
    nodes = {1: [10, 11], 2: [11, 12], 3: [10, 12], 4: [10, 11, 12], 5: [10, 13], 6: [13, 14]} | {k: [10, 11] for k in range(20, 50)} | {k: [10, 11, 12] for k in range(50, 60)}
    held = spark.createDataFrame([(k, n, 100) for k, ns in nodes.items() for n in ns], "key long, node long, size long")
    groups = spark.createDataFrame([(n, 13 if n == 14 else n) for n in range(10, 15)], "node long, component long")
    sets = spark.createDataFrame([(n, bytes(64)) for n in range(10, 15)], "node long, sketch binary")
    pairs, rest = ngram_join.crossing_pairs(held, groups, sets, ngram_join.Scratch(spark), True)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(10, 11), (10, 12), (10, 13), (11, 12)]
    assert sorted((r.key, r.node) for r in rest.collect()) == [(k, n) for k in (1, 2, 3, 4, 5) for n in nodes[k]]


def test_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "x y"), (2, "X  y"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect())
    assert got == [(-1, 2, None), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]
    assert ngram_join.similar_components(df.limit(0)).count() == 0
    rows = [(5, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (0, "x y z"), (0, ""), (7, "q r"), (7, None)]
    for kind in ("bigint", "string"):
        df = spark.createDataFrame([(str(i) if kind == "string" else i, t) for i, t in rows], f"doc_id {kind}, text string")
        assert sorted((int(r.doc_id), int(r.component_id)) for r in ngram_join.similar_components(df.union(df)).collect()) == sorted(2 * [(0, 0), (0, 0), (1, 0), (1, 0), (5, 0), (7, 7), (7, 7)])


def test_chance_equals_of_set_ids_are_told_apart(spark, monkeypatch):
    plain = ngram_join.set_hashes

    def few(value, row, rows, clashes=ngram_join.NONE):
        size, one, two = plain(value, row, rows)
        one = np.where(size > 0, one.view(np.uint64) % np.uint64(3) + np.uint64(1), np.uint64(0))
        clash = np.isin(one, clashes) & (size > 0)
        return size, np.where(clash, two.view(np.uint64), one).view(np.int64), two

    monkeypatch.setattr(ngram_join, "set_hashes", few)
    rows = list(enumerate(near_copies(4, 4)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(df).collect()} == brute_components(rows)


# --- 9: BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, rough):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(4)
    texts = [t or "" for t in awkward(2)] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x3000), 10, 32, 39, r.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(400)]
    v = bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read())
    ids, edges = v.encode_many(texts)
    for t, a, b in zip(texts, edges, edges[1:]):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want and v.decode(ids[a:b]) == tok.decode(want, skip_special_tokens=False) == t
    letters = "".join(r.choice("abcdeaaé") for _ in range(30_000))
    for t in (letters, "a" * 5001, "ab" * 4000 + " " + "the" * 3000, "=" * 3000 + "\n" + "é" * 900, " " * 4000 + "x"):
        ids, _ = v.encode_many([t])
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids and v.decode(ids) == t
    began = time.time()
    huge = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert v.decode(v.encode_many([huge])[0]) == huge and time.time() - began < 60
    odd = np.array([220, 172, 241, 50256], dtype=np.uint32)
    assert v.decode(odd) == tok.decode(odd.tolist(), skip_special_tokens=False)
    coded = bpe.encode(rough)
    back = bpe.decode(coded, carry=("n_tokens",))
    assert sorted(map(tuple, bpe.encode(rough, back=True).select("doc_id", "decoded").collect()), key=str) == sorted(map(tuple, back.select("doc_id", "decoded").collect()), key=str)
    assert sorted(r.decoded for r in back.collect()) == sorted((r.text or "") for r in rough.collect())
    assert bpe.encode(rough.limit(0)).count() == 0


# --- 10: personal data --------------------------------------------------------------------------------

KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(KINDS):
        for m in re.finditer(p, t):
            d = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    r = random.Random(6)
    for _ in range(20000):
        t = "".join(r.choice("a1@.+- (29)4") for _ in range(r.randrange(60)))
        assert pii.find(t) == brute_spans(t)
    t = "mail a.b@c-d.org, 10.0.0.256 10.0.0.255, 4111 1111-1111 1111, +1 (988) 555-2485"
    assert pii.find(t) == brute_spans(t) and len(pii.find(t)) == 4


@pytest.mark.parametrize("text,kind,span", [
    ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
    ("write jane at mail dot example dot com please", "email", "jane at mail dot example dot com"),
    ("это jоhn@exаmple.com да", "email", "jоhn@exаmple.com"),
    ("+one two three four five six seven eight nine zero one", "phone", "+one two three four five six seven eight nine zero one"),
    ("card ４１１１１１１１１１１１１１１１ ok", "card", "４１１１１１１１１１１１１１１１"),
    ("ip １９２.168.0.1", "ip", "１９２.168.0.1"),
    ("Mail jana (at) beispiel [Punkt] de bitte", "email", "jana (at) beispiel [Punkt] de"),
    ("escribe a ana arroba ejemplo punto com hoy", "email", "ana arroba ejemplo punto com"),
    ("écris à luc arobase exemple point fr", "email", "luc arobase exemple point fr"),
    ("+vier neun eins sieben null sechs fünf vier drei zwei eins", "phone", "+vier neun eins sieben null sechs fünf vier drei zwei eins"),
    ("+trois trois six un deux trois quatre cinq six sept huit", "phone", "+trois trois six un deux trois quatre cinq six sept huit"),
    ("+tres cuatro seis uno dos tres cuatro cinco seis siete ocho", "phone", "+tres cuatro seis uno dos tres cuatro cinco seis siete ocho"),
])
def test_disguises(text, kind, span):
    added = [(pii.KINDS[k], text[a:b]) for a, k, b, new in pii.spans_of(text) if new]
    assert added == [(kind, span)]
    assert pii.redacted(text) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize("text,kind", [
    ("jane [ at ] example.com", "email"), ("bob@gmail[dot]com", "email"), ("tel +४४ ७७०० ९००१२३४", "phone"), ("+1 2 three 4 five 6 seven 8 nine 0", "phone"), ("ip 10.zero.0.one", "ip"),
])
def test_disguises_need_no_other_text(text, kind):
    for t in (text, text + " that dot о"):
        assert [pii.KINDS[k] for _, k, _, new in pii.spans_of(t) if new] == [kind]


def test_gates_change_nothing():
    r = random.Random(8)
    parts = ["jane", "bob@", "@", "[at]", "( at )", "[ dot ]", "(dot)", " at ", " dot ", "com", "example", ".", "+", "1", "22", "two", "Three", "oh", "ſix", "४", "٣", "²", "а", "о", "Ａ", " ", " ", "-", "that", "4111 1111 1111 111", "é"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert pii.disguised(t) == pii.disguised(t, gates=False)


def test_planted_disguises_are_found():
    r = random.Random(14)
    words = [w for w in pii.DIGIT_WORDS]
    found = 0
    for k in range(2000):
        name, host, label = sentence(r, 1), sentence(r, 1), r.choice(pii.LABELS)
        at = r.choice(["({})", "[ {} ]", " ( {} ) ", "<{}>", " {} "]).format(r.choice(pii.AT_WORDS))
        dot = r.choice(["({})", "[ {} ]", " ( {} ) "]).format(r.choice(pii.DOT_WORDS)) if at.strip() != at.strip("[](){}<> ") else " dot "
        mail = f"{name}{at}{host}{dot}{label}"
        phone = "+" + " ".join(r.choice(words) for _ in range(11))
        text = f"{sentence(r, 5)}. {mail}; {sentence(r, 4)} {phone}. {sentence(r, 3)}"
        got = [text[a:b] for a, _, b, new in pii.spans_of(text) if new]
        found += (mail in got) + (phone in got)
    assert found >= 0.97 * 4000


@pytest.mark.parametrize("text", ["look at the dot on this page", "at one two three", "the dot com boom at home", "zero. One two", "", "at (at) dot", "Он в 5 домах"])
def test_plain_prose_is_left_alone(text):
    assert pii.spans_of(text) == [] and pii.redacted(text) == text


def test_long_texts_are_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 90_000, "1." * 90_000, "+1 " * 60_000, "one " * 40_000, "a at a dot " * 15_000):
        pii.spans_of(t)


def test_pii_frames(spark, rough):
    assert pii.detect(rough).count() == rough.count()
    clean = pii.redact(rough)
    assert clean.columns == rough.columns and clean.schema == rough.schema and clean.count() == rough.count()
    assert clean.where("text is null").count() == rough.where("text is null").count()


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(21)
    rows, labels = [], []
    for i in range(120):
        good = i % 6 != 0
        w = sentence(r, r.randrange(40, 90)).split()
        if not good:
            w = [x + "###" for x in w]
        text = " ".join(w) + (f" mail u{i}@h{i}.org" if i % 5 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(1, 30, 4):
        rows.append((200 + i, rows[i][1] + " tail", "en", "s0", 0))
    rows += [(400, None, "en", "s0", None), (401, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        frames.append((docs, docs := spark.read.parquet(str(tmp_path / f"out{k}"))))
    scores = quality_gam.score(frames[0][0], quality_gam.fit(frames[0][0], spark.read.parquet(str(tmp_path / "labels.parquet")), keep=~held_out(F.col("doc_id"))))
    assert set(table(frames[0][1])) == {r.doc_id for r in scores.collect() if r.score >= quality_gam.THRESHOLD}
    assert not {i for i in table(frames[0][1]) if i < 120 and i % 6 == 0}
    before = [(r.doc_id, r.text) for r in frames[1][0].collect()]
    parts = brute_components(before)
    assert set(table(frames[1][1])) == {d for d, c in parts.items() if d == c}
    for r in frames[2][1].collect():
        assert r.text == (None if table(frames[2][0])[r.doc_id].text is None else pii.redacted(table(frames[2][0])[r.doc_id].text))
        assert r.n_chars == (None if r.text is None else len(r.text))
    copies = collections.Counter(r.doc_id for r in frames[3][1].collect())
    assert copies == {r.doc_id: len(r.positions) for r in mixing.assign(frames[3][0]).collect() if r.positions}
    final = frames[4][1]
    assert final.count() == sum(copies.values())
    text = {d: r.text or "" for d, r in table(frames[4][0]).items()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens * 4 == len(r.ids) for r in final.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == final.count()
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_with_repeated_rows_and_clashing_names(spark):
    r = random.Random(31)
    one, two, three = (sentence(r, 40) for _ in range(3))
    rows = [(1, one), (1, one), (1, two), (2, one + " end"), (None, three), (None, three), (None, "x y"), (3, three + " end"), (4, None), (4, ""), (4, ""), (5, "solo"), (5, "solo")]
    df = spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], DOCS)
    for c in ("version", "hash", "group", "position", "positions", "node", "_id", "score", "c0", "row"):
        df = df.withColumn(c, F.lit("x"))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("text <> ''").collect()) == sorted([(1, one), (1, two), (0, "x y"), (3, three + " end"), (5, "solo")])
    assert kept.where("doc_id = 4").count() == 3
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    slim = df.select("doc_id", "source", "text")
    want = collections.Counter()
    for r in mixing.assign(slim.withColumn("t", F.coalesce("text", F.lit(""))), carry=("t",)).collect():
        want[r.doc_id, r.t] += len(r.positions)
    assert mixed.columns == df.columns and collections.Counter((r.doc_id, r.text or "") for r in mixed.collect()) == +want
    assert corpus_pipeline.personal_data(spark, df, "").columns == df.columns
    assert corpus_pipeline.tokens(spark, df, "").count() == len(rows)
