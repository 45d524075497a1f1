"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into SEGMENTS so few that one of them differs by at most one bit between any two
fingerprints that link. Each bit of a segment left out in turn gives the segment's variants; two
segments share a variant if and only if they differ by at most that bit. So an equality join on
(left out bit, rest of the segment) finds every pair that links, and the whole fingerprints are then
compared.

Equal fingerprints are one node. The members of a key never meet pair by pair at first: each key elects
a pivot at random and its members are compared with it, which joins dense groups of near copies. Only
keys whose members are in several components after that are compared member by member, and only
members of different components, so that no connection is lost. Keys of more than CROWD members are
cut again first: the other bits of two linked fingerprints differ by at most MOST too, so their
variants split the key as the first ones split the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lotline.llm.common import Scratch, components, slices, small_batches, unused

SHINGLE, BITS, MOST, SEED = 4, 64, 4, 42
SEGMENTS = MOST // 2 + 1
#: Members beyond which a key with several components is cut again.
CROWD = 256
#: Shingles hashed at a time.
STEP = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For each value of a byte, its bits.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def cuts(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` consecutive segments, as even as can be."""
    return [[int(b) for b in x] for x in np.array_split(np.array(bits), parts)]


def fingerprint(text: str | None) -> int:
    """The fingerprint, unsigned: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at ASCII blanks only
    if not words:
        return 0
    flat, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    counts, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        a, b = starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist()
        x = np.array([h(flat[i:j], SEED) for i, j in zip(a, b)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(x[:, k], minlength=256) @ _BYTE_BITS
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(starts)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, node (the fingerprint as a signed long), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(1).to_pylist()):
                got = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=["doc_id", "node"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("node", LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def variants(node: Column, segments: list[list[int]]) -> Column:
    """Array of the variants' keys: the left out bit, then the other bits of its segment, whose bits ascend
    and span less than 48 bits."""
    out = []
    for bits in segments:
        for left_out in bits:
            mask = sum(1 << b for b in bits if b != left_out)
            rest = F.shiftrightunsigned(node.bitwiseAND(F.lit(_signed(mask))), bits[0])
            out.append(F.lit(left_out << 48).bitwiseOR(rest))
    return F.array(*out)


def _linked(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MOST


def links(nodes: DataFrame, name: str = "simhash-links") -> DataFrame:
    """Links (a, b) among distinct fingerprints ``nodes`` (node) that connect all that can reach each
    other by at most MOST differing bits a step. Not every link is returned, every connection is."""
    segments = cuts(list(range(BITS)), SEGMENTS)
    with Scratch(nodes.sparkSession, name) as at:
        keyed = nodes.select("node", F.explode(variants(F.col("node"), segments)).alias("key"))
        pivots = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key"), F.col("node").alias("p")))["p"].alias("pivot"), F.count("*").alias("n")).where("n > 1")
        near = (F.col("node") != F.col("pivot")) & _linked(F.col("node"), F.col("pivot"))
        # what is neither linked nor in a key of three or more is settled here; merged, since Spark sizes what
        # explode() returns as one row per row and would broadcast all variants
        met = at.written(keyed.join(at.written(pivots, "pivots").hint("merge"), "key").where(near | (F.col("n") > 2)), "met")
        stars = at.written(met.where(near).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        roots = components(stars)
        # keys of three or more whose members are still apart
        many = met.where("n > 2").select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        many = at.written(many, "many")
        apart = many.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = at.written(many.join(apart, "key", "left_semi"), "members")
        closer = []
        for s, bits in enumerate(segments):
            others = cuts([b for k, x in enumerate(segments) if k != s for b in x], SEGMENTS)
            mine = (F.shiftright("key", 48) >= bits[0]) & (F.shiftright("key", 48) <= bits[-1])
            closer.append(members.where(mine & (F.col("n") > CROWD)).select("key", F.explode(variants(F.col("node"), others)).alias("part"), "node", "root"))
        dealt = members.where(F.col("n") <= CROWD).select("key", F.lit(-1).cast("long").alias("part"), "node", "root")
        for x in closer:
            dealt = dealt.union(x)
        dealt = at.written(dealt, "dealt")
        x, y = dealt.alias("x"), dealt.alias("y")
        match = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") < F.col("y.root")) & _linked(F.col("x.node"), F.col("y.node"))
        # merged too: columns that repeat make the files far smaller than their rows
        rest = x.join(y.hint("merge"), match).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        return at.result(stars.union(rest))


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, a row per row.

    component_id is the least doc_id of all rows whose fingerprints can be reached by steps of at most
    MOST bits. Null texts and texts without words have the fingerprint zero, which links like any
    other; texts of fewer than SHINGLE words are one shingle. Repeated rows are a row each; a null id is
    no candidate for the least id, and a class of null ids only has none. An empty table gives an empty
    result. Other columns are not read.
    """
    hex_, class_ = unused(docs.select("doc_id"), "fingerprint", "component_id")
    with Scratch(docs.sparkSession, "simhash") as at:
        rows = at.written(fingerprints(docs), "fingerprints")
        nodes = at.written(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
        roots = components(links(nodes.select("node")))
        placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = at.written(placed.select("node", "least", "root"), "placed")
        least = placed.groupBy("root").agg(F.min("least").alias(class_))
        by_node = at.written(placed.join(least, "root").select("node", class_), "classes")
        out = rows.join(by_node, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias(hex_), class_)
        return at.result(out)
