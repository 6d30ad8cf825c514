"""A quality classifier as a sparse ensemble of rules (operator 8).

Small boosted trees on statistics of labelled texts yield conjunctive rules, a lasso logistic regression weighs them, and
the rules that keep a weight become one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textstats import count_of, words_of

#: Labelled rows on which the rules are fitted, at most; taken by hash. All rows are scored.
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF = 40, 3, 15
PENALTY = 0.002
THRESHOLD = 0.3
FEATURES = ("words", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "stops", "distinct_words", "distinct_lines", "line_words", "longest_word")


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and __x: a struct of FEATURES, all doubles and never null. Null text counts as empty."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    df = df.withColumn("__words", words_of(F.col("__text"))).withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x) != ""))
    n, chars = F.greatest(F.size("__words"), F.lit(1)).cast("double"), F.greatest(F.length("__text"), F.lit(1)).cast("double")
    lines = F.greatest(F.size("__lines"), F.lit(1)).cast("double")
    count = lambda c: count_of(F.col("__text"), c)
    values = {
        "words": F.size("__words").cast("double"),
        "word_length": F.length(F.array_join("__words", "")) / n,
        "symbols": count("[#*$%&<>]") / n,
        "bars": count("[|]") / n,
        "bangs": count("[!]") / n,
        "capitals": count("[A-Z]") / chars,
        "digits": count("[0-9]") / chars,
        "stops": count("[.,;:]") / n,
        "distinct_words": F.size(F.array_distinct("__words")) / n,
        "distinct_lines": F.size(F.array_distinct("__lines")) / lines,
        "line_words": n / lines,
        "longest_word": F.coalesce(F.array_max(F.transform("__words", F.length)), F.lit(0)).cast("double"),
    }
    return df.select(*keep, F.explode(F.array(F.struct(*[values[f].alias(f) for f in FEATURES]))).alias("__x"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all to hold


def grow(x: np.ndarray, residual: np.ndarray, rng: np.random.Generator) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on quantile cuts: the rules of its nodes, and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule) -> None:
        fitted[rows] = residual[rows].mean()
        if path:
            rules.append(path)
        if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-9, -1, 0.0)
        total, n = residual[rows].sum(), len(rows)
        for f in rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]:
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
                above = v > cut
                k = int(above.sum())
                if min(k, n - k) >= LEAST_LEAF:
                    s = residual[rows][above].sum()
                    gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                    if gain > best[0]:
                        best = (gain, int(f), float(cut))
        if best[1] >= 0:
            above = x[rows, best[1]] > best[2]
            split(rows[above], (*path, (best[1], True, best[2])))
            split(rows[~above], (*path, (best[1], False, best[2])))

    split(np.arange(len(x)), ())
    return rules, fitted


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic regression on 0/1 columns, by accelerated proximal gradient."""
    n, m = z.shape
    base = min(max(y.mean(), 1e-4), 1 - 1e-4)
    b, w = float(np.log(base / (1 - base))), np.zeros(m)
    step = 4.0 / max(float(np.linalg.norm(z, 2) ** 2) / n + 1.0, 1e-9)
    ub, uw, t = b, w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ uw + ub)))
        error = (p - y) / n
        nb, nw = ub - step * float(error.sum()), uw - step * (z.T @ error)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ub, uw = nb + (t - 1) / after * (nb - b), nw + (t - 1) / after * (nw - w)
        b, w, t = nb, nw, after
    return b, w


@dataclass(frozen=True)
class RuleModel:
    constant: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, x: str = "__x") -> Column:
        """The score as a Spark expression over the statistics in struct ``x``."""
        odds = F.lit(self.constant)
        for rule, weight in self.rules:
            true = F.lit(True)
            for f, above, cut in rule:
                value = F.col(f"{x}.{FEATURES[f]}")
                true = true & (value > cut if above else value <= cut)
            odds = odds + F.when(true, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.constant + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-odds))


def fit_arrays(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighed by the lasso. One class only, or no rows, gives a constant."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(seed)
    base = y.mean()
    odds, rules = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(TREES):
        part = rng.random(len(y)) < 0.5
        grown, _fit = grow(x[part], (y - 1 / (1 + np.exp(-odds)))[part], rng)
        rules |= dict.fromkeys(grown)
        for rule in (r for r in grown if len(r) == DEPTH or not any(r == o[: len(r)] and len(o) > len(r) for o in grown)):
            on = holds(rule, x)
            p = 1 / (1 + np.exp(-odds[on]))
            odds[on] += 0.3 * np.clip((y[on] - p).sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4) if on.any() else 0
    columns: dict[bytes, Rule] = {}
    for rule in rules:  # rules that hold for the same rows say the same
        on = holds(rule, x)
        if 0 < on.sum() < len(on):
            columns.setdefault(np.packbits(on).tobytes(), rule)
    chosen = list(columns.values())
    z = np.stack([holds(r, x) for r in chosen], axis=1).astype(np.float64)
    b, w = lasso_logistic(z, y)
    return RuleModel(b, tuple((r, float(v)) for r, v in zip(chosen, w, strict=True) if abs(v) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """The model of the labelled rows that aren't held out; labels with nulls are left out."""
    taken = labels.select("doc_id", "quality").dropna().filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    train = with_statistics(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), ["doc_id", "quality"])  # at most ``rows`` short rows
    found = train.select("doc_id", "quality", "__x.*").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * rows).toPandas()
    return fit_arrays(found[list(FEATURES)].to_numpy(np.float64), found["quality"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) by row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality.

    The score is the chance of label 1 and depends on the text alone. Null text counts as empty and is scored. A null
    doc_id is not held out. Labels of one class only give a constant score, none 0.5. Other columns are not read;
    repeated rows score alike; an empty table gives no rows.
    """
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), fit(docs, labels, rows).column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
