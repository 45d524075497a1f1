"""Periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, fixture_rows

from lotline.llm import periodic, queries


def plain_runs(w):
    """Every run by trying every period at every place."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p):
                found.setdefault((i, length), p)  # periods come in ascending order
            i = j + 1
    return sorted((s, n_, p) for (s, n_), p in found.items())


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def answer(doc_id, text):
    w = planted(doc_id, plain_words(text))
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def odd_texts(rng):
    """Words over small alphabets, nested and touching runs, runs at both ends, all words the same."""
    out = [["x"] * k for k in range(1, 14)] + [fibonacci(300), list("ab" * 40), list("abcabcabcabcab"), list("aabaabaabaab" * 3)]
    for _ in range(150):
        w = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randrange(len(w)), rng.randint(1, 7)
            w[at:at] = [rng.choice("abc") for _ in range(p)] * rng.randint(3, 9)
        out.append(w)
    return out


@pytest.mark.parametrize("table", [4, 1 << 14])
def test_runs(monkeypatch, table):
    monkeypatch.setattr(periodic, "TABLE", table)
    monkeypatch.setattr(periodic, "STEP", 7 if table == 4 else 1 << 20)
    texts = odd_texts(random.Random(9)) + [[]]
    codes = {x: i for i, x in enumerate(sorted({x for t in texts for x in t}))}
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = collections.defaultdict(list)
    for k, *r in zip(*periodic.runs_of(np.array([codes[x] for t in texts for x in t]), bounds, periodic.Grid())):
        got[int(k)].append(tuple(map(int, r)))
    for k, t in enumerate(texts):
        assert got[k] == plain_runs(t), t


def test_query_on_odd_rows(spark, tmp_path):
    rows = [r[:2] for r in fixture_rows()]
    rng = random.Random(2)
    rows += [(1000 + i, rng.choice([" ", "\n", " \t\x0b "]).join(w)) for i, w in enumerate(odd_texts(rng))]
    rows += [(2000, "\x1c a\x85b a\x85b a\x85b a\x85b a\x85b a\x85b x \x00"), (2001, "Z z " * 5 + "ß " * 7), (None, "q " * 9), (None, "q " * 9)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((answer(*r) for r in rows), key=repr)


def test_operator(spark):
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    out = periodic.find_runs(docs, "key", "doc_id")
    assert out.columns == ["key", "doc_id", "n_words", "runs", "collapsed"] and out.count() == docs.count()
    one = periodic.find_runs(spark.createDataFrame([("b " * 3 + "a a a a a a a c", 5)], "text string, runs long"), "runs").first()
    assert one["n_words"] == 11 and [tuple(r) for r in one["_runs"]] == [(3, 7, 1)] and one["collapsed"] == "b b b a c"
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA), "doc_id").count() == 0


def test_long_text(spark):
    """A text of many words, periodic from its middle on."""
    rng = random.Random(4)
    w = [str(rng.randrange(500)) for _ in range(40_000)]
    w = w[:25_001] + [w[20_001 + (i % 5_000)] for i in range(14_999)]
    r = periodic.find_runs(spark.createDataFrame([(" ".join(w),)], "text string")).first()
    start, n = 20_001, 39_999 - 20_000
    while start and w[start - 1] == w[start + 4_999]:
        start, n = start - 1, n + 1
    assert (start, n, 5_000) not in [tuple(x) for x in r["runs"]] or n >= 20_000
    assert [tuple(x) for x in r["runs"] if x["period"] == 5_000] == ([(start, n, 5_000)] if n >= 20_000 else [])
