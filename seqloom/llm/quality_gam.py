"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are binned by quantiles. Cyclic boosting visits the features in turn and adds a shallow
tree on each one's bins to its lookup table; then the strongest pairs, found by their best crossing of
two cuts, get tables the same way. A score is the sigmoid of the sum of table entries, added up for
whole Arrow batches. Features come from the text alone. Null and empty texts have all counts zero and
are scored like any other; without labels, or with one label only, every score is that label's (1 if none).
Rows are scored one by one, so repeated ones alike; very long texts are handled whole. Of equally good cuts the
first is taken, and rows are sorted before a fit, so reruns agree. Ids with several labels take their rounded
mean. An empty table gives no rows. Other columns pass unchanged; where one is named score, the new one is
quality_score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import flat_bytes, map_arrow
from .labelled import labelled_sample
from .quality_rules import SLICE, sigmoid
from .text_kernel import text_stats

#: Labelled rows that a fit may use; a bounded sample by id hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, LEAF = 32, 150, 60, 6, 0.1, 1.0, 10

FEATURES = ("log_words", "word_length", "symbols", "digits", "upper", "stops", "marks", "foreign", "repeated", "distinct", "dup_lines", "line_words", "log_longest", "space")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    s = text_stats(data, offsets)
    words, chars = np.maximum(s["words"], 1), np.maximum(s["word_chars"], 1)
    letters = np.maximum(s["upper"] + s["lower"] + s["lead"], 1)
    size = np.maximum(np.diff(offsets), 1)
    return np.column_stack([
        np.log1p(s["words"]), s["word_chars"] / words, s["symbol"] / chars, s["digit"] / chars, s["upper"] / letters, s["stop"] / words, s["mark"] / words,
        s["lead"] / chars, s["repeat_words"] / words, s["distinct_words"] / words, s["dup_lines"] / np.maximum(s["lines"], 1), s["words"] / np.maximum(s["lines"], 1),
        np.log1p(s["longest_word"]), (s["space"] + s["newline"]) / size,
    ])


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.bias)
        for table, b in zip(self.tables, bins):
            out += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[bins[i], bins[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; a cut at 0 means none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < LEAF) | (n.sum() - nl < LEAF)] = 0
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of a tree of at most 2**depth leaves."""
    _, at = best_cut(g, h, n) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:at], h[:at], n[:at], depth - 1), shallow_tree(g[at:], h[at:], n[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree on two features: the better first axis is cut, then each side along the other axis."""
    options = []
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        gain, at = best_cut(a.sum(1), b.sum(1), c.sum(1))
        out = np.zeros(a.shape)
        for part in (slice(0, at), slice(at, None)) if at else (slice(0, None),):
            more, _ = best_cut(a[part].sum(0), b[part].sum(0), c[part].sum(0))
            gain += more
            out[part] = shallow_tree(a[part].sum(0), b[part].sum(0), c[part].sum(0), 1)
        options.append((gain, turned, out.T if turned else out))
    return max(options, key=lambda o: o[0])[2]


def crossing_gain(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> float:
    """Largest gain of four quadrants over the two halves that either axis alone gives."""
    best = 0.0
    for a in range(1, g.shape[0]):
        quads = [np.stack([np.cumsum(x[:a].sum(0)), np.cumsum(x[a:].sum(0))]) for x in (g, h)]
        gl, hl = (q[:, :-1] for q in quads)
        gr, hr = (q[:, -1:] - q[:, :-1] for q in quads)
        four = (gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE)).sum(0)
        rows = (quads[0][:, -1] ** 2 / (quads[1][:, -1] + RIDGE)).sum()
        cols = gl.sum(0) ** 2 / (hl.sum(0) + RIDGE) + gr.sum(0) ** 2 / (hr.sum(0) + RIDGE)
        best = max(best, float((four - np.maximum(rows, cols)).max(initial=0.0)))
    return best


def fit_matrix(x: np.ndarray, y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(60.0 if not len(y) or y[0] else -60.0)
    model = Model(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    logit = np.full(len(y), model.bias)
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = sigmoid(logit)
            step = RATE * shallow_tree(np.bincount(b, weights=y - p, minlength=len(counts[j])), np.bincount(b, weights=p * (1 - p), minlength=len(counts[j])), counts[j])
            model.tables[j] += step
            logit += step[b]
    p = sigmoid(logit)
    ranked = []
    for i in range(len(bins)):
        for j in range(i + 1, len(bins)):
            shape = (len(model.tables[i]), len(model.tables[j]))
            cell = bins[i] * shape[1] + bins[j]
            g, h, n = (np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y))))
            ranked.append((-crossing_gain(g, h, n), i, j))
    for _, i, j in sorted(ranked)[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            cell = bins[i] * table.shape[1] + bins[j]
            p = sigmoid(logit)
            g, h, n = (np.bincount(cell, weights=w, minlength=table.size).reshape(table.shape) for w in (y - p, p * (1 - p), np.ones(len(y))))
            step = RATE * pair_tree(g, h, n)
            table += step
            logit += step[bins[i], bins[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: Column | None = None) -> Model:
    """Fits on at most `sample_rows` labelled rows; `keep` is a condition on doc_id for those that may be learnt from."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*flat_bytes(batch.column(0)))
        return pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in x.T]], names=["y", *FEATURES])

    rows = map_arrow(labelled_sample(docs, labels, sample_rows, keep=keep).select("text", "y"), kernel, "y int, " + ", ".join(f"{f} double" for f in FEATURES), "text", SLICE)
    table = np.array([tuple(r) for r in rows.collect()], dtype=np.float64).reshape(-1, 1 + len(FEATURES))
    table = table[np.lexsort(table.T[::-1])]  # the order of arrival has no say
    return fit_matrix(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with `score` (0 to 1) appended; all columns and rows stay."""
    cols = docs.columns
    at = cols.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(features(*flat_bytes(batch.column(at))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    name = "score" if "score" not in cols else "quality_score"
    return map_arrow(plain, kernel, schema, f"c{at}", SLICE).toDF(*cols, name)
