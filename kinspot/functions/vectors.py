"""Vector arithmetic on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
HASH_DIM = 256
SCORE_DIGITS = 6
# ----------------------------------------------------------------------------


def as_vector(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Scale to length one; the zero vector stays as it is.

    The length enters through ``array_repeat`` and not through the lambda, so
    that it is computed once per row and not once per element.
    """
    scale = norm(v)
    lengths = F.array_repeat(F.when(scale == 0, F.lit(1.0)).otherwise(scale), F.size(v))
    return F.zip_with(v, lengths, lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hash_bucket(token: Column | str, dim: int = HASH_DIM) -> Column:
    """Feature-hashing bucket: first 28 bits of the token's MD5, modulo ``dim``."""
    digits = F.substring(F.md5(token), 1, 7)
    return (F.conv(digits, 16, 10).cast("int") % F.lit(dim)).cast("int")
