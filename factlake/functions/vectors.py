"""Vector expressions on array columns, evaluated inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities are compared and ranked at this many decimals.  The order in
# which a sum is taken changes its last bits, and equal vectors must tie
# exactly for the tie-break on id to be the same on every executor.
SIMILARITY_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector as doubles; NULL where the norm is zero."""
    length = norm(v)
    scaled = F.transform(v, lambda x: x.cast("double") / length)
    return F.when(length > 0, scaled)


def cosine_similarity(a: Column, b: Column) -> Column:
    """One minus cosine distance; NULL if either side is NULL or all zero."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.round(value, SIMILARITY_DECIMALS)


def cosine_to(v: Column, fixed: list[float]) -> Column:
    """Similarity of a column to one given vector, whose norm is taken once."""
    length = sum(x * x for x in map(float, fixed)) ** 0.5
    literal = F.array(*[F.lit(float(x)) for x in fixed])
    value = F.try_divide(dot(v, literal), norm(v) * F.lit(length))
    return F.round(value, SIMILARITY_DECIMALS)


def parse_vector(text: Column) -> Column:
    """``[0.1,0.2]`` -> array of floats."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.to_json(v)
