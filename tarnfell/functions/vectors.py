"""Column functions over vectors, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfell.functions import rules
from tarnfell.functions.binding import let
from tarnfell.functions.text import terms


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    return let(v, lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is as good as nought."""
    return let(norm(a), lambda n: let(norm(b), lambda m: F.when((n < 1e-9) | (m < 1e-9), 0.0).otherwise(dot(a, b) / (n * m))))


def relevancy(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def fit_width(v: Column, width: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


def blend(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def hash_embed(text: Column, dim: int = rules.FLAT_DIM) -> Column:
    """Signed counts of hashed terms, of length 1; ``dim`` is a power of two up to 128, so that one byte of MD5 tells both."""
    if dim & (dim - 1) or not 1 < dim <= 128:
        raise ValueError("dim must be a power of two up to 128")
    # The lowest bits of the hash are the place, the next one the sign: a code counts where it is missing once removed.
    codes = F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: F.conv(F.right(F.md5(t.cast("binary")), F.lit(2)), 16, 10).cast("int") % (2 * dim))
    place = F.sequence(F.lit(0), F.lit(dim - 1))
    return unit(
        let(
            codes,
            lambda c: F.transform(place, lambda i: (F.size(F.array_remove(c, i + dim)) - F.size(F.array_remove(c, i))).cast("double")),
        )
    )
