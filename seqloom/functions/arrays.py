"""Column expressions over arrays and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import col, portable_hash


def split_parts(text: Column | str, separator: str) -> Column:
    """Parts between separators, empty ones kept."""
    return F.split(col(text), "\\Q" + separator + "\\E", -1)


def percent(a, b) -> Column:
    return 100.0 * col(a) / col(b)


def percent_text(a, b, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", percent(a, b))


def arg_min(a: Column | str) -> Column:
    """0-based first place of the least element; -1 when empty."""
    return F.when(F.size(col(a)) > 0, F.array_position(col(a), F.array_min(col(a))) - 1).otherwise(F.lit(-1).cast("long"))


def arg_max(a: Column | str) -> Column:
    return F.when(F.size(col(a)) > 0, F.array_position(col(a), F.array_max(col(a))) - 1).otherwise(F.lit(-1).cast("long"))


def ntiles(n: int, ordered: Column | str) -> Column:
    """n + 1 elements of an ordered array at round(i / n * (size - 1)); empty for an empty array."""
    a = col(ordered)
    at = lambda i: F.element_at(a, (F.round(i / F.lit(n) * (F.size(a) - 1)) + 1).cast("int"))
    tiles = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(tiles, at)


def round_div(a, b) -> Column:
    """a / b rounded half away from zero."""
    return F.round(col(a) / col(b)).cast("bigint")


def common(a, b) -> Column:
    return F.size(F.array_intersect(col(a), col(b)))


def jaccard_distance(shared: Column, size_a: Column, size_b: Column) -> Column:
    """1 - |A and B| / |A or B| from sizes; 0 for two empty sets."""
    union = size_a + size_b - shared
    return F.when(union == 0, 0.0).otherwise(1.0 - shared / union)


def dual_distance(shared: Column, size_a: Column, size_b: Column, n: Column) -> Column:
    """Mean of the Jaccard distances of the sets and of their complements in n elements; 0 where one is undefined."""
    union = size_a + size_b - shared
    return F.when((union == 0) | (n - shared == 0), 0.0).otherwise(1.0 - 0.5 * (shared / union) - 0.5 * ((n - union) / (n - shared)))


def to_deltas(a: Column | str) -> Column:
    """First element, then successive differences."""
    c = col(a)
    return F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(c, i - 1)))


def from_deltas(a: Column | str) -> Column:
    """Running sums: the inverse of to_deltas."""
    add = lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint"))))
    return F.aggregate(col(a).cast("array<bigint>"), F.array().cast("array<bigint>"), add)


def bottom_sketch(members: Column | str, size: int, hasher=portable_hash) -> Column:
    """The `size` least distinct hashes of a set's members."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(col(members), hasher))), 1, size)


def cosine(a: Column | str, b: Column | str) -> Column:
    x, y = col(a), col(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def entropy(counts: list[Column]) -> Column:
    """Unsmoothed entropy in bits of fractions or counts."""
    total = sum(counts[1:], counts[0])
    return sum((F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))


def smoothed_entropy(counts: list[Column]) -> Column:
    """Entropy in bits of counts plus one; terms whose count is 0 are left out."""
    total = sum(counts[1:], counts[0]) + len(counts)
    return sum((F.when(c > 0, -((c + 1) / total) * F.log2((c + 1) / total)).otherwise(0.0) for c in counts), F.lit(0.0))


def cut_suffix(a: Column | str, prefix: str) -> Column:
    """`prefix_anything` becomes `prefix`."""
    c = col(a)
    return F.when(c.startswith(prefix + "_"), F.lit(prefix)).otherwise(c)


def cut_prefix(a: Column | str, prefix: str) -> Column:
    """`prefixRest` becomes `Rest`, as in "ko:K00001"."""
    c = col(a)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, F.length(c))).otherwise(c)


def json_safe(odds: Column) -> Column:
    """Infinity as -1."""
    return F.when(odds == float("inf"), -1.0).otherwise(odds)


def restore_infinity(odds: Column) -> Column:
    return F.when(odds == -1.0, float("inf")).otherwise(odds)


def extract_name(text: Column | str, pattern: str) -> Column:
    """First whole match of a pattern; an error where there is none."""
    found = F.regexp_extract(col(text), pattern, 0)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no match in "), col(text))).cast("string"))
