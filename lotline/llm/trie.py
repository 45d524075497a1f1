"""A prefix trie of conversations by distributed MSD radix partitioning.

Turns are dictionary-encoded: ids ascend with (role, text), so comparing ids compares turns. Equal
sequences of ids are one string with a weight. Strings are partitioned by their first id, then by
their second, and so on: a bucket (all strings with one prefix) that holds at most LOCAL turns,
or FEW strings, is finished in one task by multikey quicksort, which partitions by one id in three and emits a node
wherever strings share a prefix; a larger bucket is a node whose counts Spark sums, and its strings go
on to the next id. So the number of passes is the depth to which prefixes are shared by that many
turns, and no bucket of unbounded size meets in a task.

What a subtree sums (leaves, saved tokens) goes up from the finished buckets and the larger nodes to
every prefix above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import Scratch, join_small

#: Turns, and strings of any length, of a bucket that one task finishes.
LOCAL, FEW = 20_000, 16
#: Ids of members that are joined into one text before they are hashed.
BLOCK = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded(turns: DataFrame, at: Scratch) -> DataFrame:
    """Conversations of ``turns`` (conv_id, turn, role, text): conv_id, ids, sizes (UTF-8 bytes), in order."""
    said = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    slim = at.written(said.select("conv_id", "turn", key.alias("key")), "turns")
    distinct = at.written(said.select("role", "text").distinct(), "distinct")
    words = distinct.repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = at.written(words.select(key.alias("key"), F.monotonically_increasing_id().alias("id"), F.octet_length("text").cast("long").alias("size")), "dictionary")
    step = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "id", "size")
    lists = slim.join(words, "key").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("_s"))
    return lists.select("conv_id", F.col("_s.id").alias("ids"), F.col("_s.size").alias("sizes"))


def rebuilt(convs: DataFrame, base: Column, h: Column, longest: int) -> DataFrame:
    """``convs`` (conv_id, ids, sizes) with their first ``h`` turns, at most ``longest``, replaced by the first
    h of conversation ``base`` (all it has if fewer, none if there is no such conversation)."""
    most = 1 << 30
    heads = convs.select(F.col("conv_id").alias("_base"), F.slice("ids", 1, longest).alias("_ids"), F.slice("sizes", 1, longest).alias("_sizes"))
    both = convs.withColumn("_base", base).withColumn("_h", h.cast("int")).join(heads, "_base", "left")
    new = lambda c, head: F.concat(F.slice(F.coalesce(head, F.array().cast("array<long>")), F.lit(1), F.col("_h")), F.slice(c, F.col("_h") + 1, F.lit(most)))
    return both.select("conv_id", new(F.col("ids"), F.col("_ids")).alias("ids"), new(F.col("sizes"), F.col("_sizes")).alias("sizes"))


def id_hashes(members: DataFrame) -> DataFrame:
    """Of ``members`` (seq, conv_id) per seq: ends, the SHA-256 of its ids in order, comma-joined.

    Ids are sorted in ranges and joined in blocks of BLOCK; a digest is then made block by block, so a
    sequence with very many ids takes neither the memory of a task nor a row per id.
    """

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for seq, ids in rows.groupby("seq", sort=False)["conv_id"]:
                ids = ids.tolist()
                out += [(seq, ids[k], ",".join(map(str, ids[k : k + BLOCK]))) for k in range(0, len(ids), BLOCK)]
            yield pd.DataFrame(out, columns=["seq", "first", "text"])

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, digest = None, None
        for rows in parts:
            done = []
            for s, text in zip(rows["seq"], rows["text"]):
                if s != seq:
                    if digest:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["seq", "ends"])
        if digest:
            yield pd.DataFrame([(seq, digest.hexdigest())], columns=["seq", "ends"])

    ranged = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    texts = ranged.mapInPandas(blocks, "seq string, first long, text string")
    return texts.repartition("seq").sortWithinPartitions("seq", "first").mapInPandas(digests, "seq string, ends string")


def strings(convs: DataFrame, at: Scratch) -> DataFrame:
    """Distinct sequences of ``convs`` (conv_id, ids, sizes): ids, sizes, n, first (the least conv_id) and
    ends (the digest of its conversations' ids)."""
    convs = convs.withColumn("seq", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    convs = at.written(convs, "rebuilt")
    counted = at.written(convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")), "counted")
    one = convs.join(counted.withColumnRenamed("first", "conv_id"), ["seq", "conv_id"])
    several = convs.select("seq", "conv_id").join(counted.where("n > 1").select("seq"), "seq", "left_semi")
    many = at.written(id_hashes(several), "hashes")
    out = one.join(many, "seq", "left")
    return out.select("ids", "sizes", "n", F.col("conv_id").alias("first"), F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"))


class _Bucket:
    """Nodes of the strings of a bucket, each before those below it."""

    def __init__(self, depth: int):
        self.top = depth
        self.conv, self.depth, self.parent, self.n, self.children, self.own, self.ends = [], [], [], [], [], [], []
        self.tails = []

    def add(self, rows: list[tuple], depth: int, parent: int) -> int:
        n = sum(r[2] for r in rows)
        self.conv.append(min(r[3] for r in rows))
        self.depth.append(depth)
        self.parent.append(parent)
        self.n.append(n)
        self.children.append(0)
        self.own.append((n - 1) * int(rows[0][1][depth - 1]) if depth else 0)
        self.ends.append(NOTHING)
        if parent >= 0:
            self.children[parent] += 1
        return len(self.conv) - 1

    def finish(self, rows: list[tuple]) -> None:
        """Multikey quicksort of ``rows`` (ids, sizes, n, first, ends), which share their first ``top`` ids."""
        todo = [(rows, self.top, -1, True)]
        while todo:
            rows, depth, at, fresh = todo.pop()
            if fresh:  # rows share ``depth`` ids: a node
                at = self.add(rows, depth, at)
                if len(rows) == 1:
                    self.tail(rows[0], depth, at)
                    continue
                for r in rows:
                    if len(r[0]) == depth:
                        self.ends[at] = r[4]
                rows = [r for r in rows if len(r[0]) > depth]
            if not rows:
                continue
            key = [r[0][depth] for r in rows]
            pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
            todo.append(([r for r, k in zip(rows, key) if k == pivot], depth + 1, at, True))
            for side in ([r for r, k in zip(rows, key) if k < pivot], [r for r, k in zip(rows, key) if k > pivot]):
                if side:
                    todo.append((side, depth, at, False))

    def tail(self, row: tuple, depth: int, at: int) -> None:
        """The nodes of one string below node ``at``."""
        ids, sizes, n, first, ends = row
        if len(ids) == depth:
            self.ends[at] = ends
            return
        self.children[at] = 1
        own = (n - 1) * np.asarray(sizes[depth:], np.int64)
        self.tails.append((at, first, depth + 1, n, np.cumsum(own[::-1])[::-1], ends))

    def table(self) -> tuple[pd.DataFrame, int, int]:
        """Its nodes, and leaves and saved tokens of all of them."""
        leaves = [int(c == 0) for c in self.children]
        saved = list(self.own)
        for at, _, _, _, sums, _ in self.tails:
            leaves[at], saved[at] = 1, saved[at] + int(sums[0])
        for k in range(len(leaves) - 1, 0, -1):
            leaves[self.parent[k]] += leaves[k]
            saved[self.parent[k]] += saved[k]
        up = [self.conv[p] if p >= 0 else None for p in self.parent]
        parts = [pd.DataFrame({"conv_id": self.conv, "depth": self.depth, "parent_conv_id": pd.array(up, "Int64"), "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": self.ends})]
        for at, first, depth, n, sums, ends in self.tails:
            k = len(sums)
            parts.append(pd.DataFrame({
                "conv_id": first, "depth": np.arange(depth, depth + k), "parent_conv_id": pd.array([self.conv[at]] + [first] * (k - 1), "Int64"), "n_convs": n, "n_children": np.r_[np.ones(k - 1, np.int64), 0],
                "n_leaves": 1, "saved_tokens": sums, "ends_sha256": [NOTHING] * (k - 1) + [ends],
            }))
        return pd.concat(parts, ignore_index=True), leaves[0], saved[0]


def finished(buckets: DataFrame) -> DataFrame:
    """NODE and path (of a bucket's top node only) for ``buckets`` (path, ids, sizes, n, first, ends)."""
    columns = ["key", "path", "ids", "sizes", "n", "first", "ends"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple]) -> pd.DataFrame:
            path = rows[0][1]
            b = _Bucket(len(path))
            b.finish([r[2:] for r in rows])
            out = b.table()[0]
            out["path"] = [path] + [None] * (len(out) - 1)
            return out

        held: list[tuple] = []
        for part in parts:
            out = []
            for row in zip(*(part[c] for c in columns)):
                if held and held[0][0] != row[0]:
                    out.append(made(held))
                    held = []
                held.append(row)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield made(held)

    dealt = buckets.withColumn("key", F.sha2(F.array_join(F.col("path").cast("array<string>"), ","), 256)).select(*columns)
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(run, NODE + ", path array<long>")


def nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``convs`` (conv_id, ids, sizes), as NODE says.

    A node is the least conv_id of its members and its depth. n_convs counts members, n_children
    children, n_leaves the childless nodes of its subtree; saved_tokens sums (n_convs - 1) times the size
    of the last turn over its subtree, and ends_sha256 is the digest of the ids of the members that end
    there. A conversation is a record: its ids and sizes, 16 bytes a turn, fit a task.
    """
    with Scratch(convs.sparkSession, "trie") as at:
        active = at.written(strings(convs, at).withColumn("path", F.array().cast("array<long>")), "strings")
        local, upper, depth = [], [], 0
        while True:
            size = F.lit(1) + F.size("ids") - depth
            last = F.element_at("sizes", depth) if depth else F.lit(0).cast("long")
            ended = F.max(F.when(F.size("ids") == depth, F.col("ends")))
            groups = active.groupBy("path").agg(F.sum("n").alias("members"), F.min("first").alias("conv"), F.min(last).alias("last"), F.sum(size).alias("turns"), F.count("*").alias("strings"), ended.alias("ended"))
            large = at.written(groups.where((F.col("turns") > LOCAL) & (F.col("strings") > FEW)), "large")
            flagged = join_small(active, large.select("path", F.lit(True).alias("large")), ["path"], F.col("first"))
            flagged = at.written(flagged, "flagged")
            local.append(flagged.where("large is null").drop("large"))
            if large.isEmpty():
                break
            upper.append(large.drop("turns", "strings"))
            depth += 1
            rest = flagged.where(F.col("large") & (F.size("ids") >= depth)).drop("large")
            active = at.written(rest.withColumn("path", F.slice("ids", 1, depth)), "active")
        buckets = local[0]
        for x in local[1:]:
            buckets = buckets.union(x)
        below = at.written(finished(buckets), "finished")
        if not upper:
            return at.result(below.drop("path"))
        above = upper[0]
        for x in upper[1:]:
            above = above.union(x)
        above = at.written(above.withColumn("own", (F.col("members") - 1) * F.col("last")), "above")
        tops = below.where("path is not null").select("path", "n_leaves", "saved_tokens").withColumn("inner", F.lit(0))
        mine = above.select("path", F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"), F.lit(1).alias("inner"))
        # every prefix of a path, a finished bucket's own path left out
        given = tops.union(mine).select(F.explode(F.sequence(F.lit(0), F.size("path") - 1 + F.col("inner"))).alias("k"), F.size("path").alias("size"), "path", "n_leaves", "saved_tokens")
        given = given.groupBy(F.slice("path", F.lit(1), F.col("k")).alias("path")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.sum((F.col("size") == F.col("k") + 1).cast("long")).alias("n_children"))
        sums = above.join(given, "path")
        known = above.select(F.col("path").alias("up"), F.col("conv").alias("parent_conv"))
        parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
        high = sums.select(
            F.col("conv").alias("conv_id"), F.size("path").cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ended", F.lit(NOTHING)).alias("ends_sha256"), "path",
        )
        high = at.written(high, "high")
        linked = high.union(below.where("path is not null").select(high.columns)).withColumn("up", parent)
        linked = join_small(linked, at.written(known, "parents"), ["up"], F.col("conv_id"))
        linked = linked.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_conv"))
        return at.result(linked.select(below.drop("path").columns).union(below.where("path is null").drop("path")))


def conversation_trie(turns: DataFrame, base: Column | None = None, h: Column | None = None, longest: int = 0) -> DataFrame:
    """The nodes of the conversations of ``turns`` (conv_id, turn, role, text); with ``base``, of what
    rebuilt() makes of them.

    Turns are ordered by turn, null first, then role, then text; repeated rows are turns of their own. A
    null role or text is empty. Rows without a conv_id belong to no conversation. An empty table gives no
    node, not even a root. Other columns are not read.
    """
    with Scratch(turns.sparkSession, "conversations") as at:
        convs = at.written(encoded(turns, at), "encoded")
        return nodes(convs if base is None else rebuilt(convs, base, h, longest))
