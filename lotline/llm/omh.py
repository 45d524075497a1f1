"""Near-duplicates by Order MinHash (Marcais et al., 2019), verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number. A
sketch takes the TWO labelled shingles with the least hashes and keeps them in text order; BANDS
bands of ROWS sketches give candidates. Labels serve the sketches only. Two documents are linked if a
banded alignment of their shingles, where any two equal ones may meet, finds
n1 + n2 - 2 * aligned <= (n1 + n2) / 9, which is a Jaccard similarity of 0.8 or more that also
respects order.

Equal texts are one node from the start. A group of candidates never meets pair by pair: each bucket
elects a pivot and every member is aligned with it. The edit distance obeys the triangle
inequality, so most pairs are settled by their distances from the pivot; documents that a pivot does
not link are compared with its other members in blocks, where the inequality leaves them open.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import Scratch, components, slices, small_batches, unused

SHINGLE, TWO, ROWS, BANDS = 5, 2, 2, 14
#: Linked if the distance is at most this share of n1 + n2: Jaccard 0.8.
LINK = 1 / 9
#: Distances are exact up to this share of n1 + n2, beyond it they are only known to be larger.
WIDE = 0.3
#: Open documents and members of a block.
OPEN_BLOCK, MEMBER_BLOCK = 64, 256
#: Members that are aligned with one copy of their pivot's text, at most about.
PART = 128
#: Up to so many matches a shingle are aligned match by match; bytes of bit masks kept at a time.
MATCHES, MASK_BYTES = 4, 1 << 25

_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Per text the hashes of its shingles, in order (uint64). Words are runs of
    non-blanks in lower case; a text of fewer than five words is one shingle, without words none."""
    split = [(t or "").lower().split() for t in texts]
    flat = np.array([w for s in split for w in s], dtype=object)
    if not len(flat):
        return [np.zeros(0, _M) for _ in texts]
    h = pd.util.hash_array(flat, categorize=True)
    out, at = [], 0
    for s in split:
        w = h[at : at + len(s)]
        at += len(s)
        k = min(SHINGLE, len(w))
        if not k:
            out.append(np.zeros(0, _M))
            continue
        n = len(w) - k + 1
        x = np.full(n, k, _M)
        for j in range(k):
            x = _mix(x * _M(0x9E3779B97F4A7C15) + w[j : j + n])
        out.append(x)
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """The hashes of shingles, each with its occurrence number."""
    n = len(x)
    if not n:
        return x
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    if new.all():
        return x
    starts = np.flatnonzero(new)
    label = np.empty(n, np.int64)
    label[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.where(label > 0, _mix(x + label.astype(_M)), x)


def labelled_shingles(texts: list[str]) -> list[np.ndarray]:
    """Per text the hashes of its labelled shingles, in order (uint64)."""
    return [labelled(x) for x in shingles(texts)]


_SALTS = _mix(np.arange(1, ROWS * BANDS + 1, dtype=_M) * _M(0x9E3779B97F4A7C15))


def bands(x: np.ndarray) -> np.ndarray:
    """The band keys of a sequence of labelled shingles."""
    n = len(x)
    sketch = np.empty(ROWS * BANDS, _M)
    for lo in range(0, len(_SALTS), 7):  # a few at a time: long texts stay small in memory
        h = (x[None, :] ^ _SALTS[lo : lo + 7, None]) * _M(0xBF58476D1CE4E5B9)
        h ^= h >> _M(29)
        h *= _M(0x94D049BB133111EB)
        h ^= h >> _M(32)
        i = h.argmin(axis=1)
        if n == 1:
            sketch[lo : lo + len(i)] = _mix(x[i])
            continue
        h[np.arange(len(i)), i] = _M(0xFFFFFFFFFFFFFFFF)
        j = h.argmin(axis=1)
        a, b = x[np.minimum(i, j)], x[np.maximum(i, j)]
        sketch[lo : lo + len(i)] = _mix(a * _M(3) + _mix(b))
    s = sketch.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=_M)
    for r in range(ROWS):
        key = _mix(key * _M(0x9E3779B97F4A7C15) + s[:, r])
    return key.view(np.int64)


def _ends(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements ``a`` and ``b`` have in common from the start."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return int(other.argmax()) if other.any() else n


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising run among ``places``."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro, 2004): for sequences with so many
    matches that they cannot be listed."""
    if len(a) > len(b):
        a, b = b, a
    m = len(b)
    order = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(int(max(a.max(), b.max())) + 2))
    masks: dict[int, int] = {}
    full = v = (1 << m) - 1
    for s in a.tolist():
        mask = masks.get(s)
        if mask is None:
            bits = np.zeros(m, np.uint8)
            bits[order[ends[s] : ends[s + 1]]] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) * m < 8 * MASK_BYTES:
                masks[s] = mask
        u = v & mask
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def distance(a: np.ndarray, b: np.ndarray, limit: float) -> int:
    """Insertions and deletions that turn ``a`` into ``b``, by an alignment in the band
    |i - j| <= limit; exact up to ``limit``, else some larger number."""
    both = len(a) + len(b)
    start = _ends(a, b)
    a, b = a[start:], b[start:]
    end = _ends(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    both -= 2 * (start + end)
    if not len(a) or not len(b):
        return both
    names, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    n_x, n_y = np.bincount(x, minlength=len(names)), np.bincount(y, minlength=len(names))
    least = both - 2 * int(np.minimum(n_x, n_y).sum())
    if least > limit:
        return least
    n = n_y[x]  # matches of each element of a
    matches = int(n.sum())
    if matches > MATCHES * both:
        return both - 2 * _common(x[n > 0], y[n_x[y] > 0])
    # by place in a, the latest place in b first: a rising run takes one match of each element at most
    last = np.cumsum(n_y)[x] - 1
    back = np.arange(matches) - np.repeat(np.cumsum(n) - n, n)
    places = np.argsort(y, kind="stable")[np.repeat(last, n) - back]
    near = np.abs(np.repeat(np.arange(len(x)), n) - places) <= limit
    return both - 2 * _rising(places[near])


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, bands) of ``texts`` (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, pdf["text"].tolist()):
                seqs = labelled_shingles(part["text"].tolist())
                yield pd.DataFrame({"node": part["node"].to_numpy(), "bands": [bands(x) if len(x) else np.zeros(0, np.int64) for x in seqs]})

    return texts.mapInPandas(run, "node long, bands array<long>")


def _measured(pairs: DataFrame) -> DataFrame:
    """(pivot, node, d, far, n_pivot, n_node) of ``pairs`` (pivot, node, pivot_text, node_text); where
    ``far``, d is a lower bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, pdf["node_text"].tolist()):
                names, where = np.unique(part["pivot"].to_numpy(), return_index=True)
                heads = dict(zip(names.tolist(), shingles(part["pivot_text"].iloc[where].tolist())))
                seqs = shingles(part["node_text"].tolist())
                rows = []
                for p, q, y in zip(part["pivot"].tolist(), part["node"].tolist(), seqs):
                    x = heads[p]
                    wide = int(WIDE * (len(x) + len(y)))
                    d = distance(x, y, wide)
                    rows.append((p, q, min(d, wide + 1), d > wide, len(x), len(y)))
                yield pd.DataFrame(rows, columns=["pivot", "node", "d", "far", "n_pivot", "n_node"])

    return pairs.mapInPandas(run, "pivot long, node long, d long, far boolean, n_pivot long, n_node long")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block: open documents against members of the same pivot."""
    seqs = dict(zip(pdf["node"].tolist(), shingles(pdf["text"].tolist())))
    info = {r.node: (r.d, r.far, r.n, r.root) for r in pdf.itertuples(index=False)}
    opens, members = pdf.loc[pdf["is_open"], "node"].unique().tolist(), pdf.loc[~pdf["is_open"], "node"].unique().tolist()
    size = {k: len(v) for k, v in seqs.items()}
    out, up = [], {r: r for *_, r in info.values()}

    def find(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    for a in opens:
        d, d_far, n, root = info[a]
        for b in members:
            e, e_far, m, other = info[b]
            limit = LINK * (n + m)
            apart = d - e > limit and not e_far or e - d > limit and not d_far
            if a == b or apart or abs(n - m) > limit or find(root) == find(other):
                continue
            if distance(seqs[a], seqs[b], limit) <= limit:
                out.append((a, b))
                up[find(root)] = find(other)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``class_id``, the least doc_id of its class.

    Classes are connected: equal texts, and texts linked as the module says. Null and empty texts are
    equal. Texts of fewer than five words are linked only to texts with the same words. Rows with equal
    ids are one node; a row with a null id has a null class. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "near") as at:
        return at.result(_classes(docs, at))


def _classes(docs: DataFrame, at: Scratch) -> DataFrame:
    keys = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    ids = at.written(text.select("doc_id", *keys), "ids")
    nodes = at.written(ids.groupBy("h1", "h2").agg(F.min("doc_id").cast("long").alias("node")), "nodes")
    # texts stay where they are read: sketches are made of all rows, and of equal ones one is kept
    seen = _sketches(text.select(F.col("doc_id").cast("long").alias("node"), "text"))
    one = nodes.select("node").distinct()
    member = at.written(seen.join(one, "node", "left_semi").select("node", F.explode("bands").alias("key")).distinct(), "members")

    # tables of one row a bucket are written before they are joined: Spark can then split large buckets
    sizes = at.written(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = at.written(member.join(sizes, "key").select("node", "key", "n"), "shared")
    # the pivot of a bucket is the member that shares most buckets with others
    weight = at.written(shared.groupBy("node").agg(F.sum("n").alias("w")), "weights")
    weighed = shared.join(weight, "node")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("node"))).alias("p"))
    pivots = at.written(pivots.select("key", "p.w", (-F.col("p.node")).alias("pivot")), "pivots")
    # a pivot's members are dealt in parts: it has w members at most, each counted once a bucket
    parts = F.ceil(F.col("w") / (BANDS * PART)).cast("int")
    star = shared.join(pivots, "key").where("node <> pivot").select("pivot", "node", parts.alias("parts")).distinct()
    star = at.written(star.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "star")

    wanted = star.select("node").union(star.select("pivot")).distinct()
    own = text.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = at.written(own.join(wanted, "node").join(nodes.join(wanted, "node"), ["node"], "left_semi"), "texts")
    heads = star.select("pivot", "part").distinct().join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    pairs = star.select("pivot", "part", "node").join(texts.withColumnRenamed("text", "node_text"), "node").join(heads, ["pivot", "part"])
    measured = at.written(_measured(pairs), "measured")
    linked = F.col("d") <= LINK * (F.col("n_pivot") + F.col("n_node"))
    links = measured.where(linked).select(F.col("pivot").alias("a"), F.col("node").alias("b"))

    links = links.union(_open_links(measured.withColumn("linked", linked), links, texts, at))
    roots = components(links)
    classes = nodes.join(roots.select("node", "root"), "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("class_id"))
    found = ids.join(at.written(classes, "classes"), ["h1", "h2"])
    return found.select("doc_id", "class_id").unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def _open_links(measured: DataFrame, links: DataFrame, texts: DataFrame, at: Scratch) -> DataFrame:
    """Links between members of a pivot that it did not link itself."""
    roots = components(links)
    stars = measured.join(roots, "node", "left").select("pivot", "node", "d", "far", F.col("n_node").alias("n"), "linked", F.coalesce("root", "node").alias("root"))
    stars = at.written(stars, "rooted")
    # an open document can only link to a linked one if its distance is within that one's reach
    reach = F.max(F.when(F.col("linked"), F.col("d") + LINK * F.col("n")))
    per = stars.groupBy("pivot").agg(F.count("*").alias("m"), F.sum(F.when(~F.col("linked"), 1).otherwise(0)).alias("o"), reach.alias("reach"))
    per = at.written(per.where("o > 0 and m > 1"), "pivots")
    near = (F.col("o") > 1) | (F.col("d") <= F.col("reach") + LINK * F.col("n"))
    stars = stars.join(per, "pivot").withColumn("is_open", ~F.col("linked") & F.coalesce(near, F.lit(False)))
    stars = at.written(stars.drop("o"), "stars")
    stars = stars.join(at.written(stars.where("is_open").groupBy("pivot").agg(F.count("*").alias("o")), "open"), "pivot")
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    all_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cols = ["pivot", "node", "d", "far", "n", "root"]
    open_ = stars.where("is_open").select(*cols, F.lit(True).alias("is_open"), mine(blocks("o", OPEN_BLOCK)).alias("i"), all_to(blocks("m", MEMBER_BLOCK)).alias("j"))
    rest = stars.select(*cols, F.lit(False).alias("is_open"), all_to(blocks("o", OPEN_BLOCK)).alias("i"), mine(blocks("m", MEMBER_BLOCK)).alias("j"))
    rows = open_.unionByName(rest).join(texts, "node")
    return rows.groupBy("pivot", "i", "j").applyInPandas(_block_links, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each class: the one whose doc_id is the class id. Rows
    with a null id stay; of rows with equal ids all stay or go. Other columns are kept, whatever their
    names; an empty table stays empty."""
    (own,) = unused(docs, "_id")
    classes = near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(classes, F.col("doc_id") == F.col(own), "left_semi").unionByName(docs.where("doc_id is null"))
