"""Text encoders. The offline default hashes words into a fixed number of signed places; a model may be injected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import words


def hashing_encoder(text: Column, dim: int = 64) -> Column:
    """An array of dim doubles at unit length (0 for a text without words): each word adds +1 or -1 at a hashed place."""
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    places = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(dim)).alias("at"), F.when(F.pmod(F.call_function("shiftright", h, F.lit(32)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))

    def spread(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(p, lambda x: x["at"] == i), F.lit(0.0), lambda a, x: a + x["sign"]))

    raw = F.transform(F.array(places), spread)[0]
    unit = lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]
    return F.transform(F.array(raw), unit)[0]
