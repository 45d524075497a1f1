"""SimHash classes against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, fixture_rows

from lotline.llm import simhash
from lotline.llm.common import components


def plain(text):
    """The fingerprint, word by word and bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, ids):
    """Of each row the least id of its class, by comparing all pairs."""
    f, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(f))]


def test_classes(spark):
    rows = fixture_rows()
    rows += [(200 + i, t, *rows[0][2:]) for i, t in enumerate([" \x0b\x0c ", "ÄB ab\x85c d", "Ab\x1cC", "a b c d", "A b\nC\td", "one two three"])]
    rows += [(300, rows[102][1] + " tail", *rows[0][2:]), (None, "no id and alone in its class, said twice over", *rows[0][2:])]
    prints = [plain(r[1]) for r in rows]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, least_reachable(prints, [r[0] for r in rows]))), key=repr)
    got = sorted((tuple(r) for r in simhash.classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()), key=repr)
    assert got == want
    by_id = {r[0]: r[2] for r in got}
    assert by_id[204] == by_id[203] == 203 and by_id[104] == by_id[0] == 0 and by_id[100] == by_id[101] == 100


def test_no_rows(spark):
    empty = simhash.classes(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
    assert simhash.classes(spark.createDataFrame([(7, None)], "doc_id long, text string")).first()["component_id"] == 7


@pytest.mark.parametrize("crowd", [2, 256])
def test_no_connection_is_lost(spark, monkeypatch, crowd):
    """Dense clouds of fingerprints, chains of four bits a step, unrelated ones that share a segment, and
    pairs at every distance around the limit; keys are cut again beyond ``crowd`` members."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, out = random.Random(3), set()
    for spread in (2, 4, 7):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                x ^= 1 << b
            out.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        out.add(x)
    for k in range(3):
        part = sum(1 << b for b in simhash.cuts(list(range(64)), 3)[k])
        base = rng.getrandbits(64)
        out |= {(base & part) | (rng.getrandbits(64) & ~part) for _ in range(100)}
    for n in (1, 3, 4, 5, 6) * 20:
        a = rng.getrandbits(64)
        out |= {a, a ^ sum(1 << b for b in rng.sample(range(64), n))}
    nodes = sorted(out)
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "node long"))
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 4 for r in edges.collect())
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = least_reachable(nodes, range(len(nodes)))
    got = [root.get(x, x) for x in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_variants_are_not_broadcast(spark, monkeypatch):
    """Tables of variants have many times the rows that Spark counts on, so they are merged, however small
    the table of fingerprints is."""
    said, write, result = {}, simhash.Scratch.written, simhash.Scratch.result
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def written(self, df, name):
        if name == "met":
            said[name] = planned(df)
        return write(self, df, name)

    def resulting(self, df):
        if self.name == "simhash-links":
            said["links"] = planned(df)
        return result(self, df)

    monkeypatch.setattr(simhash.Scratch, "written", written)
    monkeypatch.setattr(simhash.Scratch, "result", resulting)
    simhash.links(spark.range(300).select((F.col("id") * 3).alias("node")))
    assert sorted(said) == ["links", "met"]
    assert all("SortMergeJoin" in x and "BroadcastHashJoin" not in x for x in said.values())
