"""Which files of a table may hold a key: each file's least and greatest value and a Bloom filter of its values.

A filter is cut into blocks of 32,768 bits, a row of the index each, and a value has all its bits in one block. So a
lookup reads, of the files whose range holds the value, a block each, whatever the number of values in a file; the index is a table
like any other and its size (some 12 bits a value) is never the driver's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # what one bitmap of Spark holds
BITS_A_VALUE = 12
PROBES = 6


def _block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), blocks).cast("int")


def _probes(value: Column) -> list[Column]:
    """The bits of a value within its block: two hashes, stepped."""
    h = F.xxhash64(value)
    first, step = h.bitwiseAND(BLOCK_BITS - 1), F.shiftright(h, 15).bitwiseAND(BLOCK_BITS - 1).bitwiseOR(F.lit(1))
    return [(first + step * i).bitwiseAND(BLOCK_BITS - 1) for i in range(PROBES)]


def index_of(rows: DataFrame, column: str) -> DataFrame:
    """From rows as read from files: file, least, greatest, blocks, block, bits. Nulls aren't indexed: no key finds them."""
    told = rows.select(F.col(column).alias("value"), F.col("_metadata.file_path").alias("file")).where("value IS NOT NULL")
    sizes = told.groupBy("file").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.ceil(F.count(F.lit(1)) * F.lit(BITS_A_VALUE) / F.lit(BLOCK_BITS)).cast("int").alias("blocks"))
    bits = told.join(sizes, "file").select("file", "least", "greatest", "blocks", _block(F.col("value"), F.col("blocks")).alias("block"), F.explode(F.array(*_probes(F.col("value")))).alias("bit"))
    return bits.groupBy("file", "least", "greatest", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def holding(index: DataFrame, keys: Sequence) -> DataFrame:
    """The files that may hold any of the keys: all that do, and some that don't."""
    kind = index.schema["least"].dataType

    def there(k: Column) -> Column:
        found = (k >= F.col("least")) & (k <= F.col("greatest")) & (F.col("block") == _block(k, F.col("blocks")))
        for bit in _probes(k):
            byte = F.conv(F.hex(F.substr(F.col("bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (byte.bitwiseAND(F.pow(F.lit(2), bit.bitwiseAND(7)).cast("int")) != 0)
        return found

    told = F.array(*(F.lit(k) for k in keys)).cast(f"array<{kind.simpleString()}>")
    return index.where(F.exists(told, there)).select("file").distinct()
