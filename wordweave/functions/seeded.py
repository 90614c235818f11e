"""Seeded randomness that does not depend on partitioning or on the engine.

``random()`` draws differ with every partition layout and after a lost task;
hashing a seed with the row's own identity gives the same draw wherever and
however often the row is computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 60


def digest(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw(*parts) -> Column:
    """A uniform integer in [0, 2**60) fixed by its parts."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("long")


def digits_for(rows: int, per_shard: int = 20_000) -> int:
    """Leading digits of a digest that part ``rows`` rows into shards of about
    ``per_shard``. An order by digest does not depend on it."""
    digits = 1
    while 16**digits * per_shard < rows:
        digits += 1
    return digits
