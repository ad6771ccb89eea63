"""Score and text columns: normalised scores, softmax, sigmoid, softplus; kinds, comments and file stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column, fallback: tuple[int, ...] = (0,)) -> Column:
    """Scores that sum to one: negative and unusable ones count as 0; all of the places ``fallback`` alike if none is left."""
    usable = F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")), F.lit(0.0)).otherwise(x))
    even = F.transform(values, lambda x, i: F.when(i.isin(*fallback), F.lit(1.0 / len(fallback))).otherwise(F.lit(0.0)))
    total = _total(usable)
    return F.when(total > 0, F.transform(usable, lambda x: x / total)).otherwise(even)


def softmax(values: Column) -> Column:
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda x: x / _total(powers))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (small + 1.0)).otherwise(small / (small + 1.0))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# The spellings of the two kinds of primitive queries.
KINDS = {"vf": ("vf", "vertex-face", "vertex_face", "point-triangle"), "ee": ("ee", "edge-edge", "edge_edge")}


def query_kind(text: Column) -> Column:
    """vf or ee for any known spelling, else null."""
    plain = F.lower(F.trim(text))
    return F.coalesce(*[F.when(plain.isin(*names), F.lit(kind)) for kind, names in KINDS.items()])


def without_comment(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"#.*$", ""))


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def one_hot(index: Column, size: int) -> Column:
    """An array of ``size`` zeros but for a one at ``index``; all zeros for an index that is null or elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce((i == index).cast("double"), F.lit(0.0)))
