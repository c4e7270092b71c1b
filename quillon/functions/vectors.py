"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column | str) -> Column:
    """The unit vector; zeros where the norm is next to nothing."""
    n = l2_norm(v)
    return F.transform(_double(v), lambda x: F.when(n < EPSILON, F.lit(0.0)).otherwise(x / n))


def cosine_similarity(a: Column | str, b: Column | str, strict: bool = True) -> Column:
    """In [-1, 1]; 0 if either vector is next to nothing. Of different lengths: an error if strict, else null."""
    na, nb = l2_norm(a), l2_norm(b)
    value = F.when((na < EPSILON) | (nb < EPSILON), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))
    same = F.size(_col(a)) == F.size(_col(b))
    return F.when(same, value).otherwise(F.raise_error(F.lit("DimensionMismatch")).cast("double") if strict else F.lit(None).cast("double"))


def cosine_distance(a: Column | str, b: Column | str, strict: bool = True) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b, strict)


def clamp_similarity(x: Column | str) -> Column:
    """Into [0, 1]; what is not finite becomes 0."""
    c = _col(x).cast("double")
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.0))


def surprisal(similarity: Column | str) -> Column:
    """-ln of the similarity, held in [epsilon, 1]."""
    return -F.ln(F.greatest(F.lit(EPSILON), F.least(F.lit(1.0), _col(similarity))))


def expected_information_gain(entropy: Column | str, chunks: Column | str, seen: Column | str) -> Column:
    c, d = _col(chunks), F.greatest(_col(seen), F.lit(1))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.log1p(c.cast("double")) / F.log1p(d.cast("double"))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(entropy) * ratio)))
