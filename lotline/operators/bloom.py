"""A Bloom filter of UUIDs as a distributed bit array: a table of its words that are not zero.

Every UUID sets HASHES bits, found by double hashing of the SHA-256 of its bytes. Bits are gathered by
word with a bitwise or, which combines before it shuffles, and a probe is a join by word, so neither
side is ever held whole. The stored form is one binary file: magic, number of bits, words; files without
the first two are read as well.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stored form: bits set by an entry, bits of a word, magic, header (magic, number of bits)
HASHES, WORD_BITS = 7, 32
MAGIC, HEADER = b"BLM1", "<4sq"
#: Words that are put together, or read, at a time.
SEGMENT = 1 << 16
TABLE = "word long, bits int"


def _digest(uuid: Column) -> Column:
    """The SHA-256, in hexadecimal digits, of the bytes of ``uuid``, 32 hexadecimal digits."""
    # the first three groups of a UUID are numbers, whose bytes are stored from the last
    order = [3, 2, 1, 0, 5, 4, 7, 6]
    return F.sha2(F.unhex(F.concat(*[F.substring(uuid, 2 * k + 1, 2) for k in order], F.substring(uuid, 17, 16))), 256)


def _limb(digest: Column, i: int) -> Column:
    """The ``i``-th four bytes of a hexadecimal digest as a number, little-endian."""
    x = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    byte = lambda c, mask: c.bitwiseAND(F.lit(mask))
    return byte(F.shiftright(x, 24), 0xFF).bitwiseOR(byte(F.shiftright(x, 8), 0xFF00)).bitwiseOR(byte(F.shiftleft(x, 8), 0xFF0000)).bitwiseOR(byte(F.shiftleft(x, 24), 0xFF000000))


def _position(limbs: list[Column], k: Column, bits: int) -> Column:
    """(first + k * step) mod 2^63 mod ``bits``, of two numbers of 63 bits in ``limbs`` of 32; a step of 0 is 1.
    No sum of limbs overflows a long."""
    low, high, step_low, step_high = limbs[0], limbs[1], limbs[2], limbs[3].bitwiseAND(F.lit(0x7FFFFFFF))
    step_low = F.when((step_low == 0) & (step_high == 0), F.lit(1).cast("long")).otherwise(step_low)
    sum_low = low + step_low * k
    sum_high = high + step_high * k + F.shiftright(sum_low, 32)
    whole = F.shiftleft(sum_high.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(sum_low.bitwiseAND(F.lit(0xFFFFFFFF)))
    return whole % F.lit(bits).cast("long")


def positions(uuid: Column, bits: int) -> Column:
    """The bits (an array of longs, repeats possible) that ``uuid``, 32 hexadecimal digits, sets."""
    limbs = [_limb(_digest(uuid), i) for i in range(4)]
    return F.array(*[_position(limbs, F.lit(k).cast("long"), bits) for k in range(HASHES)])


def _valid(rows: DataFrame, uuid: str) -> DataFrame:
    return rows.select(F.col(uuid).alias("_uuid")).where(F.col("_uuid").rlike("^[0-9a-f]{32}$"))


def _set_bits(ids: DataFrame, bits: int) -> DataFrame:
    """uuid, word and bit of each position of the valid UUIDs ``ids``: positions(), with its digest and
    numbers as columns of their own, so that each is worked out once a row."""
    ids = ids.select("_uuid", _digest(F.col("_uuid")).alias("_digest"))
    ids = ids.select("_uuid", *[_limb(F.col("_digest"), i).alias(f"_l{i}") for i in range(4)])
    ids = ids.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(HASHES)])).alias("_k"))
    at = ids.select("_uuid", _position([F.col(f"_l{i}") for i in range(4)], F.col("_k"), bits).alias("_at"))
    return at.select("_uuid", F.call_function("div", "_at", F.lit(WORD_BITS)).alias("word"), F.expr(f"shiftleft(1, cast(_at % {WORD_BITS} AS int))").alias("_bit"))


def built(rows: DataFrame, uuid: str, bits: int) -> DataFrame:
    """The words (word, bits) of a filter of the UUIDs in ``rows``; nulls and what is no normal UUID set none.

    A repeated UUID sets its bits again, which changes nothing: only words are shuffled, not UUIDs.
    """
    return _set_bits(_valid(rows, uuid), bits).groupBy("word").agg(F.bit_or("_bit").alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The union of filters of one size."""
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probed(rows: DataFrame, uuid: str, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` with may_exist: false means that no such UUID was added. What is no UUID does not exist."""
    bit = _set_bits(_valid(rows, uuid).distinct(), bits).join(words, "word", "left")
    there = bit.groupBy("_uuid").agg(F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).alias("_there"))
    return rows.join(there, F.col(uuid) == F.col("_uuid"), "left").withColumn("may_exist", F.coalesce("_there", F.lit(False))).drop("_uuid", "_there")


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(words: DataFrame, path: str, bits: int) -> None:
    """Write the filter as one file at ``path``, in place of one that is there.

    Tasks put segments together; the driver passes them on in order, one at a time. The file appears
    under its name when it is whole.
    """
    spark, n = words.sparkSession, -(-bits // WORD_BITS)

    def segment(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        out = np.zeros(min(SEGMENT, n - k * SEGMENT), "<i4")
        rows = rows[rows["word"].notna()]
        out[rows["word"].to_numpy(np.int64) - k * SEGMENT] = rows["bits"].to_numpy(np.int64)
        return pd.DataFrame({"segment": [k], "data": [out.tobytes()]})

    every = spark.range(-(-n // SEGMENT)).select(F.col("id").alias("segment"), F.lit(None).cast("long").alias("word"), F.lit(None).cast("int").alias("bits"))
    rows = every.unionByName(words.select(F.call_function("div", "word", F.lit(SEGMENT)).alias("segment"), "word", "bits"))
    data = rows.groupBy("segment").applyInPandas(segment, "segment long, data binary").orderBy("segment")
    fs, at = _file(spark, path)
    part = at.suffix(".part")
    out = fs.create(part, True)
    out.write(struct.pack(HEADER, MAGIC, bits))
    for row in data.toLocalIterator():
        out.write(bytes(row["data"]))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def load(spark: SparkSession, path: str, bits: int | None = None) -> tuple[DataFrame, int]:
    """The words of the file at ``path`` and its number of bits. A file without header has ``bits``; words
    beyond what its bits take are left out, words that it lacks are zero. One task reads the file, whose
    size is fixed when a filter is made; segments are dealt from there."""
    size = struct.calcsize(HEADER)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("h")).first()["h"]
    skip = 0
    if len(head) == size and struct.unpack(HEADER, head)[0] == MAGIC and struct.unpack(HEADER, head)[1] > 0:
        skip, bits = size, struct.unpack(HEADER, head)[1]
    if bits is None:
        raise ValueError(f"{path} has no header: its number of bits must be given")
    n = -(-bits // WORD_BITS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = np.frombuffer(content.as_buffer(), "<i4", offset=skip, count=min(n, (len(content.as_buffer()) - skip) // 4))
                for k in range(0, len(data), SEGMENT):
                    at = np.flatnonzero(data[k : k + SEGMENT])
                    yield pa.RecordBatch.from_arrays([pa.array(at + k), pa.array(data[at + k].astype(np.int32))], names=["word", "bits"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(words, TABLE), bits
