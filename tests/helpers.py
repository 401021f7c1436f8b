import math

from verbspark.sources import from_rows

NA = None
NAN = float("nan")
INF = float("inf")


def frame(spark, schema, *rows):
    return from_rows(spark, [r if isinstance(r, tuple) else (r,) for r in rows], schema)


def plain(value):
    """Values that compare, NaN as a text."""
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, list):
        return [plain(v) for v in value]
    return tuple(plain(v) for v in value) if isinstance(value, tuple) else value


def rows(f):
    return [plain(tuple(r)) for r in f.collect()]


def values(f, name):
    return [plain(v) for v in f.pull(name)]
