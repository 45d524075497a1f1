"""The conversation trie against brute force."""

import collections
import hashlib
import random
import zlib

import pytest

from lotline.llm import queries, trie

SCHEMA = "turn long, conv_id long, role string, text string, path string, n_leaves long"


def fixture_turns():
    """Shared beginnings, equal conversations, null turns, roles, texts and ids, repeated rows, ties, a
    conversation of one turn of nothing, one of very many turns, a very long text."""
    rng, rows = random.Random(8), []
    for c in range(120):
        for t in range(rng.randint(1, 12)):
            rows.append((t, c, rng.choice(["user", "assistant"]), f"turn {t} ä {rng.randint(0, 1)}"))
    for c in range(200, 260):  # copies
        rows += [(t, c, "user", f"same {t}") for t in range(9)]
    rows += [(None, 300, "user", "first"), (1, 300, "user", "b"), (1, 300, "user", "a"), (1, 300, "user", "a"), (1, 300, "assistant", "z"), (-5, 300, None, "x")]
    rows += [(None, None, None, None), (0, None, "user", "of no one"), (0, 301, None, None), (0, 302, "", ""), (0, 303, "user", "y " * 200_000), (0, 303, "user", "y " * 200_000)]
    rows += [(t, c, "user", f"long {t if t != 700 else c}") for c in (400, 405, 407) for t in range(900)]
    rows += [(0, 10**12 + 1, "user", "far"), (3, -7, "user", "below nothing")]
    return rows


def plain(rows):
    own = collections.defaultdict(list)
    for turn, c, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = turns.get(base, [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    tree, of = {}, {}  # a node by its parent and turn: long conversations stay cheap
    for c in sorted(full):
        node = 0
        members[0].append(c)
        for t in full[c]:
            node = tree.setdefault((node, t), len(tree) + 1)
            members[node].append(c)
        of.setdefault(node, []).append(c)
    kids, up, last = collections.defaultdict(list), {0: None}, {0: ""}
    for (a, t), b in tree.items():
        kids[a].append(b)
        up[b], last[b] = a, t[1]
    depth, leaves, saved = {0: 0}, {}, {}
    for b in sorted(up):
        if b:
            depth[b] = depth[up[b]] + 1
    for b in sorted(up, reverse=True):
        leaves[b] = sum(leaves[k] for k in kids[b]) or 1
        saved[b] = (len(members[b]) - 1) * len(last[b].encode()) + sum(saved[k] for k in kids[b])
    if not full:
        return []
    return sorted(
        (min(members[b]), depth[b], min(members[up[b]]) if b else None, len(members[b]), len(kids[b]), leaves[b], saved[b], hashlib.sha256(",".join(map(str, sorted(of.get(b, [])))).encode()).hexdigest())
        for b in up
    )


@pytest.mark.parametrize(("local", "few", "block"), [(20_000, 16, 4096), (40, 2, 7)])
def test_trie(spark, tmp_path, monkeypatch, local, few, block):
    for name, value in (("LOCAL", local), ("FEW", few), ("BLOCK", block)):
        monkeypatch.setattr(trie, name, value)
    rows = fixture_turns()
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    if local == 40:  # each pass is a job: without the conversations of 900 shared turns
        rows = [r for r in rows if r[1] not in (400, 405, 407)]
        spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_conversation_trie(spark, str(tmp_path))
    assert out.columns == [c.split()[0] for c in trie.NODE.split(", ")]
    assert sorted(map(tuple, out.collect())) == plain(rows)


def test_edges(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    nobody = spark.createDataFrame([(None, None, None, None, "x", 1)], SCHEMA)
    assert trie.conversation_trie(nobody).count() == 0
    one = trie.conversation_trie(spark.createDataFrame([(0, 4, None, None, "x", 1)], SCHEMA)).collect()
    assert sorted((r["depth"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in one) == [(0, 1, 1, 0), (1, 0, 1, 0)]
    assert one[0]["ends_sha256"] != one[1]["ends_sha256"]
