"""Vector, image-hash and bit functions, as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, summed in order as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_finite(v: Column) -> Column:
    """Whether a vector holds neither NaN nor infinity."""
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction of two arrays of vectors: for each of the query's the best inner product, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def average_hash(pixels: Column) -> Column:
    """Bits as '0' and '1', row by row: set where a pixel is at least the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x.cast("double") >= mean, "1").otherwise("0")), "")


def difference_hash(pixels: Column, width: int) -> Column:
    """Bits as '0' and '1', row by row: set where a pixel is greater than its right neighbour."""
    inner = F.filter(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: i % width < width - 1)
    return F.array_join(F.transform(inner, lambda i: F.when(F.get(pixels, i) > F.get(pixels, i + 1), "1").otherwise("0")), "")


def bits_to_long(bits: Column) -> Column:
    """A string of at most 64 bits as a long, the first bit the lowest; bit 63 is the sign."""
    return F.aggregate(
        F.transform(F.split(bits, ""), lambda b, i: F.when(b == "1", F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda s, x: s.bitwiseOR(x),
    )


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))
