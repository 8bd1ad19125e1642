"""Which rows may have an id among those of a table: told by bits, so that other rows need not be shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits an id, and 2 ** least to 2 ** most of them in all: 16 MB at most.
BITS, LEAST, MOST = 32, 15, 27


def may_be_among(df: DataFrame, key: str, ids: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """``df`` with a boolean column ``name`` that is true wherever the long ``key`` is among ``ids`` (one column).

    It is true for a few other rows too, one in ``BITS`` while the bits suffice; with more ids than that for more rows. So a join on
    the exact ids must follow, which gets only these rows. A null key is not among the ids. The bits are a table of pages of 4 KB,
    which is broadcast; only the number of ids reaches the driver.
    """
    n = 1 << min(most, max(LEAST, (BITS * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n)) + 1
    own = ids.select(F.col(ids.columns[0]).alias("id")).where("id is not null").select(slot("id").alias("s"))
    page, bits, at = f"{name}_page", f"{name}_bits", f"{name}_at"
    pages = own.groupBy(F.bitmap_bucket_number("s").alias(page)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits))
    df = df.withColumn(at, F.when(F.col(key).isNotNull(), slot(key))).withColumn(page, F.bitmap_bucket_number(at))
    byte = f"cast(conv(hex(substring(`{bits}`, cast(bitmap_bit_position(`{at}`) div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position(`{at}`) % 8 as int)) & 1 = 1, false)")
    return df.join(F.broadcast(pages), page, "left").withColumn(name, hit).drop(page, bits, at)
