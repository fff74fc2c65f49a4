"""Quality by a sparse ensemble of rules.

Small trees are boosted on text statistics; every path from a root to a node is
a conjunctive rule; a lasso logistic regression weighs the rules, and those with
a weight become one Spark column expression.  Statistics are column expressions
too, so scoring stays inside the JVM.

Null and empty texts have statistics of 0 and get the score that the rules give
those.  Repeated rows get equal scores, a null ``doc_id`` stays null.  With no
labelled row, or one class only, the score is the share of label 1 (0.5 without
any).  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_labels, training_rows
from .mixture import word_count

#: Labelled documents of each class to fit on, at most.
TRAINING_ROWS = 6000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "#$%&*|<>{}[]=_~^@\\/+"
STATISTICS = ["words", "mean_word", "upper", "marks", "digits", "shouts", "pipes", "stops", "lines", "repeated_lines", "repeated_parts"]


def with_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more`` and the statistics of the whole text; shares are per character."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", *more, body.alias("b"), F.length(body).alias("n"), word_count(F.col("text")).alias("words"))
    without = lambda chars: F.col("n") - F.length(F.translate("b", chars, ""))
    only = lambda c: F.col("n") - F.length(F.replace("b", F.lit(c), F.lit("")))
    share = lambda x: x / F.greatest(F.col("n"), F.lit(1))
    lines = F.split("b", "\n")
    # Short texts by their lines; long stretches are compared by their parts between full stops.
    parts = F.split("b", "[.!?|]+[ \n]+")
    repeated = lambda a: 1 - F.size(F.array_distinct(a)) / F.size(a)
    return d.select(
        "doc_id",
        *more,
        F.col("words").cast("double").alias("words"),
        ((F.col("n") - only(" ") - only("\n")) / F.greatest(F.col("words"), F.lit(1))).alias("mean_word"),
        share(without(_UPPER)).alias("upper"),
        share(without(_MARKS)).alias("marks"),
        share(without("0123456789")).alias("digits"),
        share(only("!")).alias("shouts"),
        share(only("|")).alias("pipes"),
        share(only(".")).alias("stops"),
        share(only("\n")).alias("lines"),
        repeated(lines).alias("repeated_lines"),
        repeated(parts).alias("repeated_parts"),
    )


#: A rule: (statistic, above, threshold) conditions that must all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> F.Column:
        """The score as one column expression over the statistics."""
        cond = lambda c: (F.col(c[0]) > c[2]) if c[1] else (F.col(c[0]) <= c[2])
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(reduce(lambda a, b: a & b, map(cond, rule)), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, path: Rule, rows: np.ndarray, names: list[str], rules: list[Rule], value: np.ndarray) -> None:
    """Grow one tree of a boosting round over ``rows``; collect the paths and write the leaves' values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, -1)
    if depth:
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            gs = np.cumsum(np.bincount(bins[rows, k], weights=grad[rows], minlength=len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, k], weights=hess[rows], minlength=len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 2) | (h - hs < 2)] = 0
            j = int(gain.argmax())
            best = max(best, (float(gain[j]), k, j))
    if best[1] < 0:
        value[rows] = -g / (h + 1)
        return
    _, k, j = best
    left = bins[rows, k] <= j
    for above, part in ((False, rows[left]), (True, rows[~left])):
        step = (*path, (names[k], above, float(cuts[k][j])))
        rules.append(step)
        grow(x, bins, cuts, grad, hess, depth - 1, step, part, names, rules, value)


def simplified(rule: Rule) -> Rule:
    """The tightest condition of each statistic and side, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, t in rule:
        old = tight.get((name, above))
        tight[name, above] = t if old is None else max(old, t) if above else min(old, t)
    return tuple((n, a, t) for (n, a), t in sorted(tight.items()))


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, t in rule:
        v = x[:, names.index(name)]
        out &= v > t if above else v <= t
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradient; the bias is free."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate = 4.0 / (np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2 / n)
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(z @ pw + pb, -30, 30))) - y) / n
        nw, nb = pw - rate * (z.T @ r), pb - rate * r.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = STATISTICS, *, trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """Rules of boosted trees with lasso weights."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
        return RuleModel(float(np.log(p / (1 - p))), [])
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 48)))[:-1] for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        value = np.zeros(len(y))
        grow(x, bins, cuts, p - y, p * (1 - p), depth, (), np.arange(len(y)), names, rules, value)
        margin += 0.3 * value
    rules = list(dict.fromkeys(map(simplified, rules)))
    z = np.stack([holds(r, x, names) for r in rules], 1).astype(float)
    b, w = lasso(z, y.astype(float), penalty)
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> RuleModel:
    """Fit on the statistics of at most ``limit`` labelled rows a class that aren't held out; the bias follows the classes' full counts."""
    rows = training_rows(docs, labels, "quality", limit, limit)
    table = with_statistics(rows, "label").orderBy("doc_id", *STATISTICS).toPandas()
    y = table["label"].to_numpy(int)
    model = fit(table[STATISTICS].to_numpy(float), y)
    if len(y) and y.min() != y.max():
        full = {r["label"]: r["count"] for r in training_labels(labels, "quality").groupBy("label").count().collect()}
        model.bias += float(np.log(full[1] / full[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score of every whole text."""
    return with_statistics(docs).select("doc_id", model.column().alias("score"))
