"""Quality classifier: a sparse rule ensemble (after Friedman and Popescu's RuleFit, 2008).

Statistics of the text feed a small random forest; every path from a root becomes a conjunctive rule;
a logistic regression with an L1 penalty weighs rules and keeps few. The kept rules are compiled into
one Spark column, so scoring is a projection of built-in functions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weighted rows that a task of the lasso holds, at least, where there are as many.
TASK_ROWS = 5000


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text; null counts as empty. Rates are per character, word or line."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    without = lambda *chars: sum(((n - F.length(F.replace(t, F.lit(c), F.lit("")))) for c in chars[1:]), n - F.length(F.replace(t, F.lit(chars[0]), F.lit(""))))
    w = F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " ", -1)
    n_words = F.size(w).cast("double")
    ln = F.split(t, "\n", -1)
    n_lines = F.size(ln).cast("double")
    return {
        "log_chars": F.log1p(n),
        "hash_marks": per(without("#", "$", "%", "&", "*"), n),
        "bars": per(without("|"), n),
        "shouts": per(without("!"), n),
        "stops": per(without("."), n_words),
        "commas": per(without(","), n_words),
        "spread": per(F.size(F.array_distinct(w)).cast("double"), n_words),
        "line_spread": per(F.size(F.array_distinct(ln)).cast("double"), n_lines),
        "word_length": per(n, n_words),
        "line_length": per(n, n_lines),
        "capitals": per(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("double"), n),
        "digits": per(F.length(F.regexp_replace(t, r"[^0-9]+", "")).cast("double"), n),
        "odd": per(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,]+", "")).cast("double"), n),
    }


FEATURES = ["log_chars", "hash_marks", "bars", "shouts", "stops", "commas", "spread", "line_spread", "word_length", "line_length", "capitals", "digits", "odd"]


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, is_greater, value), all of which must hold, and a weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, value in self.conditions:
            out = out & ((F.col(name) > value) if greater else (F.col(name) <= value))
        return out


def tree_rules(debug: str, features: list[str]) -> list[tuple[tuple[str, bool, float], ...]]:
    """The conjunctions on the paths of a tree, inner nodes included, from its printed form."""
    paths, out = [], []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        paths = [p for p in paths if p[0] < depth] + [(depth, (features[int(m[2])], m[3] == ">", float(m[4])))]
        out.append(simplified(tuple(p[1] for p in paths)))
    return list(dict.fromkeys(out))


def simplified(conditions: tuple[tuple[str, bool, float], ...]) -> tuple[tuple[str, bool, float], ...]:
    """Of several bounds of one feature on one side, the tightest; in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, greater, value in conditions:
        old = best.get((name, greater), value)
        best[name, greater] = max(old, value) if greater else min(old, value)
    return tuple(sorted((n, g, v) for (n, g), v in best.items()))


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1, from the statistics' columns."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, label: str, trees: int = 12, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """Fit on ``rows``: the statistics and ``label`` (0 or 1; null labels are left out).

    All rows count; the fits are Spark jobs. Without rows of both labels the score is constant: the
    share of label 1, or a half without any labels.
    """
    rows = rows.where(F.col(label).isin(0, 1)).select(*FEATURES, F.col(label).cast("double").alias("_y"))
    n, ones = rows.agg(F.count("*"), F.sum("_y")).first()
    if not n or ones in (0, n):
        share = min(max((ones or 0) / n if n else 0.5, 0.01), 0.99)
        return RuleEnsemble((), math.log(share / (1 - share)))
    table = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.8).fit(table)
    found = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString, FEATURES)))
    if not found:
        return RuleEnsemble((), math.log(ones / (n - ones)))
    names = [f"_r{i}" for i in range(len(found))]
    flags = rows.select("_y", *[Rule(c).column().cast("double").alias(k) for c, k in zip(found, names)])
    # rows that meet the same rules are one weighted row
    flags = flags.groupBy("_y", *names).agg(F.count("*").cast("double").alias("_w"))
    held = VectorAssembler(inputCols=names, outputCol="_x").transform(flags).cache()
    table = held.coalesce(1 + held.count() // TASK_ROWS)  # many passes over what may be few rows
    lasso = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(table)
    held.unpersist()
    kept = tuple(Rule(c, float(w)) for c, w in zip(found, lasso.coefficients) if abs(w) > 1e-6)
    return RuleEnsemble(kept, float(lasso.intercept))
