"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

A document is a bag of words weighted by how often they occur. For sample k and word t, hashes give
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with n = floor(ln w / r + b), the sample is the word whose
a = c * exp(-r * (n - b + 1)) is least, together with n. Two documents agree in a sample with a
probability equal to their generalised Jaccard similarity, sum(min w) / sum(max w).

Only built-in column functions are used: samples are columns of compiled code over a row for each word
and BLOCK samples, reduced to one row a document and block in the task that has the document. Texts that
stand together (a text, its edited one, the next) have many words in common, so those of MEMBERS // 2
places are sampled together, each word once for all texts that have it equally often. A gamma
variable is a sum of two exponential ones; these are looked up by STEPS hashed bits, so that a sample
takes one logarithm.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Samples that are columns of one row: compiled code for more of them is too long to be made fast.
BLOCK = 8
#: Texts of which a word that some have equally often is sampled once: bits of a long.
MEMBERS = 32
#: Ranges of doc_id into which the documents are dealt, at least.
RANGES = 64
#: Bits of a hash that choose an exponential variable.
STEPS = 12
_SPLIT = r"[\x20\x09-\x0D]+"


def weighted(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, _term (a hash of the word) and _n (how often it occurs) per distinct word of ``text``; a text
    without words has one row, with nulls.

    Words are hashed before they are sorted, so that numbers are sorted, not strings; equal ones stand
    together and a word begins where a hash differs from the one before it. Each step is a column of its
    own, worked out once.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT), "")
    rows = rows.select(*keep, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("_terms"))
    new = lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1))
    starts = F.when(F.size("_terms") > 0, F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), new))
    rows = rows.select(*keep, "_terms", starts.alias("_starts"))
    rows = rows.select("*", F.posexplode_outer("_starts").alias("_at", "_start"))
    end = F.coalesce(F.get("_starts", F.col("_at") + 1), F.size("_terms"))
    return rows.select(*keep, F.get("_terms", F.col("_start")).alias("_term"), (end - F.col("_start")).alias("_n"))


def _exponentials() -> Column:
    """-ln u at the middles of 2^STEPS equal parts of (0, 1), folded to one literal. Exploded from a list
    of its own, it stands in the plan once and rows refer to it."""
    n = 1 << STEPS
    return F.array(*[F.lit(-math.log((i + 0.5) / n)) for i in range(n)])


def _sample(term: Column, lnw: Column, i: Column, table: Column) -> Column:
    """ln a and, in the low 24 bits, a name of the word and n: the least of a document is its sample.

    With STEPS bits r and c are at most 18.1 and at least 0.0002, so -64 < ln a < 64 for any weight.
    """
    h1, h2 = F.xxhash64(term, 2 * i), F.xxhash64(term, 2 * i + 1)
    bits = lambda h, shift, n: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1))
    gamma = lambda h: F.get(table, bits(h, 64 - STEPS, STEPS).cast("int")) + F.get(table, bits(h, 64 - 2 * STEPS, STEPS).cast("int"))
    r = gamma(h1)
    b = (bits(h2, 8, 32) + 0.5) / float(1 << 32)
    n = F.floor(lnw / r + b)
    ln_a = F.log(gamma(h2)) - r * (n - b + 1)
    # the low 40 bits of h1 choose nothing else; n, less than 2^17, changes them by an odd constant
    name = bits(h1.bitwiseXOR(n * F.lit(0x9E3779B1)), 8, 24)
    return F.shiftleft(((ln_a + 64.0) * float(1 << 32)).cast("long"), 24).bitwiseOR(name)


def signatures(rows: DataFrame, by: list[str], member: list[str], text: str, k: int = SAMPLES) -> DataFrame:
    """Per ``by`` and ``member``: ``fingerprint``, the samples of the words of ``text``.

    There is one row per ``by`` and ``member``. ``member`` is no column or one: a number below MEMBERS.
    A word that several members of a ``by`` have equally often is sampled once for all of them, whose
    numbers are the bits of a long. Where ``rows`` are hash-dealt by some of ``by`` nothing is shuffled
    again.
    """
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    who = F.bit_or(bit(F.col(member[0])) if member else F.lit(1).cast("long"))
    words = weighted(rows, [*by, *member], text).groupBy(*by, "_term", "_n").agg(who.alias("_who"))
    blocks = F.explode(F.array(*[F.lit(i) for i in range(0, k, BLOCK)]))
    each = words.select(*by, "_who", "_term", F.log(F.col("_n").cast("double")).alias("_lnw")).select("*", F.explode(F.array(_exponentials())).alias("_table")).select("*", blocks.alias("_from"))
    names = [f"s{i}" for i in range(min(k, BLOCK))]
    some = [_sample(F.col("_term"), F.coalesce("_lnw", F.lit(0.0)), F.col("_from") + i, F.col("_table")).alias(s) for i, s in enumerate(names)]
    each = each.select(*by, "_who", "_from", F.isnull("_lnw").alias("_none"), *some)
    members = F.explode(F.array(*[F.lit(i) for i in range(MEMBERS if member else 1)]))
    each = each.select("*", members.alias("_member")).where(F.col("_who").bitwiseAND(bit(F.col("_member"))) != 0)
    parts = each.groupBy(*by, "_member", "_from").agg(*[F.min(c).alias(c) for c in ["_none", *names]])
    empty = F.lit("-" * 6 * len(names))
    parts = parts.select(*by, "_member", "_from", F.when(F.col("_none"), empty).otherwise(fingerprint(len(names))).alias("_f"))
    whole = F.concat(*[F.max(F.when(F.col("_from") == i, F.col("_f"))) for i in range(0, k, BLOCK)])
    out = parts.groupBy(*by, "_member").agg(F.substring(whole, 1, 6 * k).alias("fingerprint"))
    return out.select(*by, *[F.col("_member").alias(c) for c in member], "fingerprint")


def fingerprint(k: int = SAMPLES, prefix: str = "s") -> Column:
    """The samples as text: six hexadecimal digits each; of a document without words, dashes."""
    one = lambda c: F.coalesce(F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit((1 << 24) - 1))), 6, "0")), F.lit("------"))
    return F.concat(*[one(F.col(f"{prefix}{i}")) for i in range(k)])


def likeness(a: Column, b: Column, k: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree: an estimate of generalised Jaccard.

    Samples are cut out as bytes; to find a place in a string, all characters before it are counted.
    """
    at = lambda x, i: F.substring(x.cast("binary"), 6 * i + 1, F.lit(6))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(a, i) == at(b, i))) / k


def _constant(values: list) -> Column:
    """An array of longs, one literal however long it is; folded before it runs."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _rank_in(c: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are less than ``c``, by halving steps; 0 for null."""
    if not cuts:
        return F.lit(0)
    table = _constant(cuts)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) < c), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) dealt in ranges of doc_id, each row knowing the text that follows.

    Gives _range, _place, doc_id, text, next_text and _own. Ids ascend, null ids come first, equal ids
    are ordered by text; the first document follows the last. The first row of each range is also
    lent to the range before it (_own is false there), so no range waits for another: the only
    shuffle is the one that deals the texts. There are several ranges to a shuffle partition unless
    ``ranges`` says how many; the driver gets one id a range.
    """
    ranges = ranges or max(RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, max(100_000, 10 * ranges))).first()[0] or [])) if shares else []
    which = lambda c: _rank_in(c, cuts)
    firsts = ids.groupBy(which(F.col("doc_id")).alias("r")).agg(F.min("doc_id").alias("id"), F.max(F.isnull("doc_id")).alias("nulls")).orderBy("r").collect()  # a row per range
    at = lambda values: F.get(_constant([None if v is None else int(v) for v in values]), F.col("_r"))
    known = {f["r"]: (f["id"], f["nulls"], firsts[i - 1]["r"]) for i, f in enumerate(firsts)}
    first, nulls, before = zip(*[known.get(r, (None, False, None)) for r in range(len(cuts) + 1)])
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), which(F.col("doc_id")).cast("int").alias("_r"))
    lent = F.when(F.when(at(nulls) == 1, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == at(first)), at(before).cast("int"))
    own = F.struct(F.col("_r").alias("r"), F.lit(0).alias("late"))
    loan = F.struct(F.col("_lent").alias("r"), F.lit(1).alias("late"))
    rows = docs.select("doc_id", "text", "_r", lent.alias("_lent"))
    rows = rows.select("doc_id", "text", F.explode(F.filter(F.array(own, F.when(F.col("_lent").isNotNull(), loan)), lambda x: x.isNotNull())).alias("_at"))
    rows = rows.select(F.col("_at.r").alias("_range"), F.col("_at.late").alias("_late"), "doc_id", "text").repartition("_range")
    order = Window.partitionBy("_range").orderBy("_late", F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("_range", F.row_number().over(order).alias("_place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), (F.col("_late") == 0).alias("_own"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(other, F.lit("")), F.lit(1), half))


def compare_edited(docs: DataFrame, k: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.

    A null text is empty. Two texts without words have a likeness of 1, one with and one without
    words of 0. A table of one row follows itself. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = with_next(docs, ranges)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    facts = rows.select("_range", "_place", "_own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))
    texts = rows.select("_range", "_place", "_own", F.explode(both).alias("_x")).where(F.col("_own") | (F.col("_x.v") == 0))
    near = F.floor(F.col("_place") / (MEMBERS // 2))  # a text, its edited one and those beside them
    texts = texts.select("_range", near.alias("_near"), (F.col("_place") % (MEMBERS // 2) * 2 + F.col("_x.v")).alias("_m"), F.col("_x.t").alias("_t"))
    sig = signatures(texts, ["_range", "_near"], ["_m"], "_t", k).withColumn("_place", (F.col("_near") * (MEMBERS // 2) + F.floor(F.col("_m") / 2)).cast("int"))
    one = lambda v: F.max(F.when(F.col("_m") % 2 == v, F.col("fingerprint")))
    two = sig.groupBy("_range", "_place").agg(one(0).alias("fingerprint"), one(1).alias("edited_fingerprint"))
    # both sides are a narrow row per document; the texts, dealt once, are read for each
    two = two.join(facts.hint("merge"), ["_range", "_place"])
    order = Window.partitionBy("_range").orderBy("_place")
    two = two.withColumn("_next", F.lead("fingerprint").over(order)).where("_own")
    return two.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next"), k).alias("near_next"),
    )
