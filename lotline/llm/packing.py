"""Packing token sequences: bulk-synchronous best fit.

Documents and gaps are sorted by size into runs of equal size. A round sweeps from the largest size
down: every document, longest first, takes the smallest gap that holds it and that no longer one has
taken. In the order of that sweep gaps open and documents close like brackets, so running sums over
the runs give each gap and each document its rank, the depth at which it opens or closes, and a
document meets the gap before it at the same rank. Gaps shrink and the next round sweeps what is left,
until no document is. Runs are cut into slices, SLICES to a partition of the session, so a size that many
share is dealt out and there are as many runs as sizes and slices, whatever the number of documents; no
rank has more rows than there are sizes. The driver sees a few sums a round. Where few documents are left
and gaps are few, as in most of the last rounds, a round is one task and shuffles nothing: hundreds of
nearly empty tasks a round would fill the driver with what it keeps of each.

It starts from as many empty sequences as the tokens fill. Where there are many documents to a gap,
some of one length are placed as one unit, which saves rounds. If no gap holds what is left, as many
sequences as that fills are added.
"""

from __future__ import annotations

import functools
import struct
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotline.llm.common import BROADCAST_ROWS, Scratch, join_small, slices, small_batches

#: Slices to a partition, and the least number of documents or gaps of one size in a slice.
SLICES, LEAST_SLICE = 4, 500
#: Documents to a gap beyond which some of one length are placed as one unit.
PER_GAP = 2
UNIT = "struct<length: bigint, slice: bigint, nth: bigint, k: bigint>"
#: Entries of each table of ids that a task keeps before it starts anew.
CACHE = 500_000
#: The module in which a worker process keeps them: functions travel whole, and so do their own modules.
STAYS = "_lotline_llm_chunks"

PIECE = "piece int, start long, length long, ids binary"


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters beyond ASCII as a byte-level tokenizer spells their UTF-8: bytes that print stand
    for themselves, the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    spelled = {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(128, 256) if chr(c).isalpha()}


#: Marks that end a word and are a token run of their own; not the apostrophe, which may begin a token.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PROBES = ["word", "WORD", "extraordinarily", "señor", "ÀÉ", "straße", "naïve", "zwölf"]


class Chunks(dict):
    """Ids of chunks, the parts of a text between blanks, as little-endian uint32: each is made when it
    is first asked for.

    Most chunks are letters and then marks. If lower-case letters can go straight to the tokenizer's
    model, which PROBES tell, only what the chunk's letters and marks are made of is encoded, each
    once; everything else is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()
        self.direct = all(self._letters(w) == self._whole(w) == self._whole(w + MARKS)[: len(self._letters(w))] for w in PROBES)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str) -> bytes:
        return self._pack([t.id for t in self.tok.model.tokenize(word.lower().translate(self.letters))])

    def _whole(self, chunk: str) -> bytes:
        return self._pack(self.tok.encode(chunk, add_special_tokens=False).ids)

    def _part(self, x: str, make) -> bytes:
        got = self.parts.get(x)
        if got is None:
            got = self.parts[x] = make(x)
        return got

    def __missing__(self, c: str) -> bytes:
        word = c.rstrip(MARKS)
        if self.direct and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
            got = self._part(word.lower(), self._letters)
            if len(word) < len(c):
                got += self._part(c[len(word) :], self._whole)
        else:
            got = self._whole(c)
        self[c] = got
        return got

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > CACHE:
            self.clear()
        if len(self.parts) > CACHE:
            self.parts = {"": b""}
        # ids never depend on what stands beyond white space
        return [b"".join(map(self.__getitem__, (t or "").replace("\n", " ").split(" "))) for t in texts]


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids (little-endian uint32).

    A null or empty text is just the end id. Only documents of more than ``capacity`` ids are cut.
    Repeated rows and null ids are kept, a row each; ids of any type and size come back as they are.
    Other columns are not read.
    """
    names = ["piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process serves many tasks: tokenizer and tables of ids stay for the next one
        kept = sys.modules.setdefault(STAYS, types.ModuleType(STAYS)).__dict__
        chunks = kept.setdefault(tokenizer_path, None) or Chunks(tokenizer_path)
        kept[tokenizer_path] = chunks
        end, step = struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            for part in slices(batch, batch.column(1).to_pylist()):
                which, out = [], []
                for row, ids in enumerate(chunks.ids(part.column(1).to_pylist())):
                    ids += end
                    which += [row] * -(-len(ids) // step)
                    out += [(k, k * capacity, (min(len(ids), at + step) - at) // 4, ids[at : at + step]) for k, at in enumerate(range(0, len(ids), step))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *columns], names=["doc_id", *names])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, StructType(rows.schema.fields[:1] + StructType.fromDDL(PIECE).fields))


def _per_slice(spark: SparkSession, n: int) -> int:
    """Rows of a slice where there are ``n`` rows in all."""
    return max(LEAST_SLICE, -(-n // (SLICES * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _sliced(rows: DataFrame, size: str, by: Column, n: int) -> DataFrame:
    """``rows``, ``n`` of them, with ``slice``: a part of at most about _per_slice() of the rows of a ``size``.
    There are no more sizes than the capacity, which bounds what is broadcast."""
    parts = rows.groupBy(size).agg(F.ceil(F.count("*") / _per_slice(rows.sparkSession, n)).alias("_parts"))
    return rows.join(F.broadcast(parts), size).withColumn("slice", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")


def _round(at: Scratch, docs: DataFrame, gaps: DataFrame, capacity: int, per_gap: float, n_gaps: int, widest: int) -> tuple[DataFrame, DataFrame]:
    """One sweep of ``docs`` (length, slice, n, done: runs of documents and how many of each have a place)
    over ``n_gaps`` ``gaps`` (seq, gap): the runs after it, and the gaps after it with what each took.

    Up to BROADCAST_ROWS gaps and documents together are one task's work."""
    few = n_gaps * (1 + per_gap) <= BROADCAST_ROWS
    gathered = lambda rows: rows.coalesce(1) if few else rows
    gaps = gathered(gaps)
    k = F.greatest(F.least(F.lit(int(per_gap / PER_GAP)), F.floor(F.lit(widest) / F.col("length")), F.col("n")), F.lit(1)).cast("long")
    docs = docs.withColumn("k", k).withColumn("units", F.when(F.col("length") <= widest, F.floor(F.col("n") / F.col("k"))).otherwise(0).cast("long"))
    none = F.lit(None).cast("long")
    # no size can have more gaps than there are
    per_slice = _per_slice(at.spark, n_gaps)
    sliced = _sliced(gaps, "gap", F.col("seq"), n_gaps) if n_gaps > per_slice else gaps.withColumn("slice", F.lit(0).cast("long"))
    opening = sliced.groupBy("gap", "slice").agg(F.count("*").alias("change"))
    events = opening.select(F.col("gap").alias("size"), F.lit(0).alias("kind"), "slice", "change", none.alias("length"), none.alias("n"), none.alias("done"), none.alias("k"))
    events = events.unionByName(docs.select((F.col("length") * F.col("k")).alias("size"), F.lit(1).alias("kind"), "slice", (-F.col("units")).alias("change"), "length", "n", "done", "k"))
    # a row per run: the sizes of gaps and documents, and their slices beyond the first
    order = Window.orderBy(F.col("size").desc(), "kind", "slice", "length")
    runs = events.withColumn("_sum", F.sum("change").over(order)).withColumn("_low", F.least(F.min("_sum").over(order), F.lit(0)))
    runs = runs.withColumn("after", F.col("_sum") - F.col("_low")).withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0).cast("long")))
    runs = at.written(runs.drop("_sum", "_low"), "runs")

    start = runs.where("kind = 0").select(F.col("size").alias("gap"), "slice", "before")
    if min(n_gaps, capacity) + n_gaps // per_slice <= BROADCAST_ROWS:  # no more runs than that
        opened = sliced.join(F.broadcast(start), ["gap", "slice"])
    else:
        opened = join_small(sliced, start, ["gap", "slice"], F.col("seq"))
    nth = F.row_number().over(Window.partitionBy("gap", "slice").orderBy("seq"))
    opened = opened.select((F.col("before") + nth).alias("rank"), F.col("gap").alias("size"), F.lit(0).alias("kind"), "seq", F.lit(None).cast(UNIT).alias("unit"))
    # runs are few: they are dealt out before each becomes as many rows as it has documents
    parts = min(int(at.spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(per_gap * n_gaps) // 5000)
    taken = runs.where("kind = 1 and before > after")
    taken = taken.coalesce(1) if few else taken.repartition(parts, "length", "slice")
    taken = taken.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("before") - F.col("after") - 1)))
    unit = F.struct("length", "slice", (F.col("done") + F.col("_i") * F.col("k")).alias("nth"), "k").cast(UNIT)
    closed = taken.select((F.col("before") - F.col("_i")).alias("rank"), "size", F.lit(1).alias("kind"), none.alias("seq"), unit.alias("unit"))
    sweep = Window.partitionBy("rank").orderBy(F.col("size").desc(), "kind")
    met = gathered(opened.unionByName(closed)).withColumn("unit", F.lead("unit").over(sweep)).where("kind = 0")
    used = F.coalesce(F.col("unit.length") * F.col("unit.k"), F.lit(0))
    gaps = at.written(met.select("seq", (F.col("size") - used).alias("gap"), "unit.*", (F.lit(capacity) - F.col("size")).alias("offset")), "gaps")
    placed = (F.col("before") - F.col("after")) * F.col("k")
    return runs.where("kind = 1").select("length", "slice", (F.col("n") - placed).alias("n"), (F.col("done") + placed).alias("done")), gaps


def _places(at: Scratch, docs: DataFrame, capacity: int) -> DataFrame:
    """Places for ``docs`` (length, slice, n): per document, the nth of its run, seq and offset."""
    docs = docs.withColumn("done", F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    gaps = at.spark.range(0).select(F.col("id").alias("seq"), F.col("id").alias("gap"))
    rounds, opened, before, least = [], 0, None, 1
    while True:
        docs, gaps = docs.where("n > 0"), gaps.select("seq", "gap").where(F.col("gap") >= least)
        both = docs.select("n", "length", none.alias("gap")).union(gaps.select(none, none, "gap"))
        left, tokens, least, n_gaps, widest = both.agg(F.sum("n"), F.sum(F.col("n") * F.col("length")), F.min("length"), F.count("gap"), F.max("gap")).first()
        if not left:
            break
        if not n_gaps or left == before:
            new = -(-tokens // capacity)
            fresh = at.spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            gaps, opened, n_gaps, widest = fresh.unionByName(gaps), opened + new, n_gaps + new, capacity
        before = left
        docs, gaps = _round(at, docs, gaps, capacity, left / n_gaps, n_gaps, widest)
        rounds.append(gaps.where("length is not null"))
    if not rounds:
        return at.spark.createDataFrame([], "length long, slice long, nth long, seq long, offset long")
    each = functools.reduce(DataFrame.unionByName, rounds)
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return each.select("length", "slice", (F.col("nth") + F.col("_i")).alias("nth"), "seq", (F.col("offset") + F.col("_i") * F.col("length")).cast("long").alias("offset"))


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths add up to ``capacity`` at most.

    pieces: doc_id, piece, start, length and other narrow columns (not the ids: this is written).
    Rows that are equal, or have a null id, get places of their own; so do ties of length, in any order.
    A piece of ``capacity`` ids or more is a sequence. An empty table gives an empty result. Columns
    named sequence_id or offset are replaced; other names don't matter.
    """
    pieces = pieces.drop("sequence_id", "offset")
    keep = pieces.columns
    with Scratch(pieces.sparkSession, "packed") as at:
        rows = at.written(pieces.select(F.struct(*keep).alias("kept"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")), "rows")
        full = rows.where(F.col("length") >= capacity).select("kept.*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        open_ = at.written(_sliced(rows.where(F.col("length") < capacity), "length", F.col("row"), rows.count()), "open")
        counts = at.written(open_.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")
        places = _places(at, counts, capacity)
        ranked = open_.withColumn("nth", (F.row_number().over(Window.partitionBy("length", "slice").orderBy("row")) - 1).cast("long"))
        found = ranked.join(places, ["length", "slice", "nth"]).select("kept.*", F.col("seq").alias("sequence_id"), "offset")
        return at.result(found.unionByName(full))


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (binary, little-endian uint32), from
    ``pieces`` with ids and ``places`` as packed() gives them."""
    both = pieces.join(places.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))


