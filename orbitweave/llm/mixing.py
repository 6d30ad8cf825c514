"""Mixing documents to target domain weights (operator 2), in DataFrame functions only.

A naive Bayes classifier, fitted on the labelled rows, gives each document soft membership of domains. Projected gradient
descent finds nonnegative rates so that the domains' expected tokens meet their targets in the least-squares sense, each
domain's miss taken relative to its tokens and weighted by them. In the metric that weighs a rate by its document's tokens
the gradient of a rate is the product of its document's posteriors with the misses, so a round is a few sums over distinct
posteriors. Rates are a column beside these, written each round; rounds go on until nothing is gained.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textstats import count_of, words_of
from orbitweave.session import durable

#: Domains by the labels' quality and toxic; targets are shares of all tokens.
DOMAINS = ("poor", "poor_toxic", "sound", "sound_toxic")
TARGETS = {"sound": 0.85, "sound_toxic": 0.05, "poor": 0.08, "poor_toxic": 0.02}
#: Labelled rows on which the classifier is fitted, at most; taken by hash.
TRAIN_ROWS = 20_000
#: Words that tell labels apart, at most, and the labelled documents in which one must stand.
SIGNAL_WORDS = 64
SIGNAL_DOCUMENTS = 5
#: The descent ends where all targets are met within TOLERANCE (of a domain's tokens), or where two rounds in turn take less
#: than this share off the squared miss, as with targets out of reach.
TOLERANCE, STILL = 1e-4, 1e-4
#: Lengths of step that a round tries, along the curvature (with its small directions cut off) and along the gradient.
CURVED, CUTS, PLAIN = (8.0, 1.0, 0.3, 0.1), (1e-10, 1e-4, 1e-2), tuple(8.0**i for i in range(6))
#: Distinct posteriors that a task of a round looks at, about.
KINDS_PER_TASK = 50_000
#: Rows of one posterior that are not dealt out, however few rows there are in all.
HOT_ROWS = 1_000


@dataclass(frozen=True)
class DomainModel:
    """Log prior and log weights by feature, by domain; and the words whose presence is a feature."""

    signals: tuple[str, ...]
    constants: tuple[float, ...]
    weights: tuple[dict[str, float], ...]


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, __tokens (words by white space), __looks (bucketed statistics, as name=value) and __letters.

    __letters are the lower-case words of letters, some of them twice. They are cut from the distinct words alone, and
    characters are counted in what one pass leaves of the text.
    """
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).withColumn("__words", words_of(F.col("__text")))
    df = df.select(
        *keep,
        F.size("__words").alias("__n"),
        F.length("__text").alias("__length"),
        F.array_distinct("__words").alias("__distinct"),
        F.regexp_replace("__text", "[^#*$%&|<>!?A-Z]+", "").alias("__marks"),
    )
    n = F.greatest("__n", F.lit(1))
    bucket = lambda name, x, most: F.concat(F.lit(f"{name}="), F.least(F.floor(x), F.lit(most)).cast("string"))
    looks = F.array(
        bucket("words", F.log2(n), 16),
        bucket("symbols", 8 * count_of(F.col("__marks"), "[#*$%&|<>]") / n, 8),
        bucket("bangs", 8 * count_of(F.col("__marks"), "[!?]") / n, 8),
        bucket("capitals", 8 * count_of(F.col("__marks"), "[A-Z]") / F.greatest("__length", F.lit(1)), 8),
        bucket("distinct", 10 * F.size("__distinct") / n, 10),
    )
    letters = F.split(F.btrim(F.regexp_replace(F.lower(F.array_join("__distinct", " ")), r"[^\p{L}]+", " ")), " ")
    return df.select(*keep, F.col("__n").cast("long").alias("__tokens"), looks.alias("__looks"), letters.alias("__letters"))


def with_signals(df: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """``df`` of :func:`with_features` with __letters given up for one more look: how many ``signals`` stand there, 2 at most."""
    hits = F.size(F.array_intersect("__letters", F.array(*[F.lit(s) for s in signals]))) if signals else F.lit(0)
    look = F.concat(F.lit("signals="), F.least(hits, F.lit(2)).cast("string"))
    return df.withColumn("__looks", F.concat("__looks", F.array(look))).drop("__letters")


def _domain() -> Column:
    return F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "poor_toxic").otherwise("poor")).otherwise(F.when(F.col("toxic") == 1, "sound_toxic").otherwise("sound"))


def fit_domains(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DomainModel:
    """The classifier of ``labels`` (doc_id, quality, toxic; rows with nulls are left out) over ``docs``' texts."""
    taken = (
        labels.select("doc_id", _domain().alias("domain"), "quality", "toxic").dropna().select("doc_id", "domain")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(rows)
    )
    train = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most ``rows`` short rows
    train = durable(with_features(train, ["domain"]))  # the texts of those rows are read once
    toxic = F.col("domain").endswith("toxic").cast("int")
    counts = train.select(F.explode(F.array_distinct("__letters")).alias("word"), toxic.alias("toxic")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    total = train.agg(F.coalesce(F.sum(toxic), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("a") + 0.5) / (F.lit(total[0]) + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (F.lit(total[1] - total[0]) + 1.0))
    top = counts.filter((F.col("n") >= SIGNAL_DOCUMENTS) & (F.col("word") != "")).withColumn("score", F.col("a") * odds)
    signals = tuple(r.word for r in top.filter(odds > 3).orderBy(F.desc("score"), "word").limit(SIGNAL_WORDS).collect())
    looks = with_signals(train, signals)
    table = looks.select("domain", F.explode("__looks").alias("look")).groupBy("domain", "look").count().collect()  # buckets, not rows
    sizes = {d: 0 for d in DOMAINS} | {r.domain: r["count"] for r in looks.groupBy("domain").count().collect()}
    names = {look.split("=")[0] for look in (r["look"] for r in table)}
    values = {name: {r["look"] for r in table if r["look"].startswith(f"{name}=")} for name in names}
    seen = {(r.domain, r["look"]): r["count"] for r in table}
    weight = lambda d, look: math.log((seen.get((d, look), 0) + 0.5) / (sizes[d] + 0.5 * len(values[look.split("=")[0]])))
    everything = sorted(set().union(*values.values())) if values else []
    return DomainModel(
        signals,
        tuple(math.log((sizes[d] + 1) / (sum(sizes.values()) + len(DOMAINS))) for d in DOMAINS),
        tuple({look: weight(d, look) for look in everything} for d in DOMAINS),
    )


def with_posteriors(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, __tokens, and __posterior: an array by domain, rounded to six places, of sum about 1."""
    df = with_signals(with_features(docs, keep), model.signals)

    def log_score(k: int) -> Column:
        if not model.weights[k]:
            return F.lit(model.constants[k])
        table = F.create_map(*[F.lit(x) for pair in model.weights[k].items() for x in pair])
        return F.aggregate("__looks", F.lit(model.constants[k]), lambda s, look: s + F.coalesce(F.try_element_at(table, look), F.lit(0.0)))

    df = df.withColumn("__scores", F.array(*[log_score(k) for k in range(len(DOMAINS))]))
    df = df.withColumn("__raised", F.transform("__scores", lambda s: F.exp(s - F.array_max("__scores"))))
    df = df.withColumn("__posterior", F.transform("__raised", lambda x: F.round(x / F.aggregate("__raised", F.lit(0.0), lambda a, b: a + b), 6)))
    return df.drop("__looks", "__scores", "__raised")


@dataclass(frozen=True)
class Fit:
    """(__posterior, n, rate) of the distinct posteriors, the largest miss of a domain relative to its tokens, the rounds, and whether they sufficed."""

    rates: DataFrame
    residual: float
    rounds: int
    settled: bool


def fit_rates(members: DataFrame, targets: dict[str, float], whole: str | None = None, rounds: int | None = None) -> Fit:
    """Rates from 1 on to the least-squares fit of ``targets`` (shares, by domain); ``rounds`` at most, if given.

    ``members`` has __tokens and __posterior. The tokens wanted in all are those there are; with ``whole``, as many as
    let that domain keep its own. A round asks the cluster for the curvature over the rates that may move, tries steps of
    several lengths along it and along the gradient in one aggregate, each cut at zero, and takes the best. A rate at zero
    that the gradient would lower stays out of steps along the curvature.
    """
    p, ks = [F.get("__posterior", F.lit(k)) for k in range(len(DOMAINS))], range(len(DOMAINS))
    kinds = durable(members.groupBy("__posterior").agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.lit(1.0)))
    kinds = kinds.coalesce(-(-kinds.count() // KINDS_PER_TASK) or 1)
    total_of = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    names = [f"v{k}" for k in ks]

    def beside(rows: list[tuple]) -> DataFrame:
        """Each kind with each of a few rows of (i, curved, e by domain, v by domain): as data, so that the code of all rounds is compiled once."""
        cells = lambda r: ", ".join([f"{r[0]} AS i", f"{str(r[1]).lower()} AS curved", *[f"{float(x)!r}D AS e{k}" for k, x in zip(ks, r[2])], *[f"{float(x)!r}D AS {n}" for n, x in zip(names, r[3])]])
        each = kinds.selectExpr("__posterior", "n", "tokens", "rate", f"inline(array({', '.join(f'struct({cells(r)})' for r in rows)}))")
        held = (F.col("rate") <= 0) & (sum((p[k] * F.col(f"e{k}") for k in ks), F.lit(0.0)) > 0)
        after = F.greatest(F.lit(0.0), F.col("rate") - sum((p[k] * F.col(names[k]) for k in ks), F.lit(0.0)))
        return each.withColumn("held", held).withColumn("after", F.when(F.col("held") & F.col("curved"), 0.0).otherwise(after))

    have = np.array(kinds.agg(*[total_of(p[k] * F.col("tokens")) for k in ks]).first(), float)
    share = np.array([targets.get(d, 0.0) for d in DOMAINS]) / max(sum(targets.values()), 1e-300)
    total = have.sum()
    if whole is not None and targets.get(whole, 0) > 0:
        total = have[DOMAINS.index(whole)] / share[DOMAINS.index(whole)]
    scale = np.where(have > 0, have, 1.0)
    miss = lambda mass: np.where(have > 0, (mass - share * total) / scale, 0.0)
    squared = lambda e: float((scale / scale.sum() * e**2).sum())
    error, k, still = miss(have), 0, 0
    while (settled := np.abs(error).max() < TOLERANCE or still == 2) is False and (rounds is None or k < rounds):
        free = F.when(F.col("held"), 0.0).otherwise(F.col("tokens"))
        curve = np.array(beside([(0, True, error, error)]).agg(*[total_of(p[i] * p[j] * free) for i in ks for j in ks]).first(), float).reshape(len(ks), -1)
        root = np.sqrt(scale)
        along = [np.linalg.lstsq(curve / scale[:, None] * root[:, None], error * root, rcond=cut)[0] for cut in CUTS]
        steps = [(True, a * g) for g in along for a in CURVED] + [(False, a * error) for a in PLAIN]
        tried = beside([(i, curved, error, v) for i, (curved, v) in enumerate(steps)]).groupBy("i").agg(*[total_of(p[k] * F.col("tokens") * F.col("after")) for k in ks])
        masses = {r[0]: np.array(r[1:], float) for r in tried.collect()}
        masses = [masses.get(i, np.zeros(len(ks))) for i in range(len(steps))]
        best = min(range(len(steps)), key=lambda i: squared(miss(masses[i])))
        before, then = squared(error), miss(masses[best])
        k, still = k + 1, still + 1 if squared(then) > before * (1 - STILL) else 0
        if squared(then) < before:
            kinds, error = durable(beside([(best, steps[best][0], error, steps[best][1])]).select("__posterior", "tokens", "n", F.col("after").alias("rate"))), then
    residual = float(np.abs(error).max())
    if not settled:
        warnings.warn(f"the rates did not settle in {rounds} rounds; a domain misses its target by {residual:.4f} of its tokens", stacklevel=2)
    return Fit(durable(kinds.select("__posterior", "n", "rate")), residual, k, bool(settled))


def with_rates(rows: DataFrame, fit: Fit) -> DataFrame:
    """``rows`` (with __posterior) and their ``rate``. Posteriors that many rows share are sent to all tasks, and their rows dealt out."""
    hot = fit.rates.join(F.broadcast(hot_keys_of(fit.rates)), "__posterior", "left_semi")
    met = rows.join(F.broadcast(hot.select("__posterior", F.col("rate").alias("__hot_rate"))), "__posterior", "left")
    apart = F.when(F.col("__hot_rate").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).cast("int")
    own = fit.rates.select("__posterior", F.col("rate").alias("__own_rate"), F.lit(0).alias("__apart"))
    return met.withColumn("__apart", apart).join(own, ["__posterior", "__apart"], "left").withColumn("rate", F.coalesce("__hot_rate", "__own_rate")).drop("__hot_rate", "__own_rate", "__apart")


def hot_keys_of(rates: DataFrame) -> DataFrame:
    """Posteriors of more rows than a shuffle partition's share of all, and than HOT_ROWS: fewer than there are partitions."""
    parts = int(rates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = max(HOT_ROWS, (rates.agg(F.sum("n")).first()[0] or 0) // parts)
    return durable(rates.filter(F.col("n") > large).select("__posterior"))


def _copies(rate: Column) -> Column:
    """The rate rounded to whole copies, up or down by a hash of the document's id, so that it holds on average."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + draw).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, whole: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies, residual) by row of ``docs`` (doc_id, text; other columns are not read).

    Null text counts as empty and has no tokens. Without labelled rows all domains are equally likely. A domain without
    tokens can't be filled and is left out of the fit. Repeated rows count as often as they stand there; rows that agree
    in doc_id draw alike. ``residual``, the same in all rows, is the largest miss of a domain in expectation, relative to
    the tokens it has: targets may be out of reach. An empty table gives no rows.
    """
    model = fit_domains(docs, labels)
    scored = durable(with_posteriors(docs.select("doc_id", "text"), model, ["doc_id"]))  # a few numbers a document, so that texts are read once
    fit = fit_rates(scored, targets or TARGETS, whole)
    cells = [F.get("__posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    rated = with_rates(scored, fit).select("doc_id", F.col("__tokens").alias("n_tokens"), *cells, "rate")
    return rated.withColumn("copies", _copies(F.col("rate"))).withColumn("residual", F.lit(fit.residual))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, whole: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; with ``whole``, documents likeliest of that domain stay at least once.

    Nulls, repeated rows and tables without rows or labels count as in :func:`mixture`. The caller's columns ride in one
    struct, so that no name of theirs can clash.
    """
    model = fit_domains(docs, labels)
    scored = with_posteriors(docs.select("doc_id", "text", F.struct("*").alias("row")), model, ["doc_id", "row"])
    fit = fit_rates(scored.drop("row"), targets or TARGETS, whole)
    scored = with_rates(scored, fit)
    copies = _copies(F.col("rate"))
    if whole is not None:
        likeliest = F.array_position("__posterior", F.array_max("__posterior")) == DOMAINS.index(whole) + 1
        copies = F.when(likeliest, F.greatest(copies, F.lit(1))).otherwise(copies)
    return scored.select("row", F.explode(F.array_repeat(F.lit(True), copies)).alias("copy")).select("row.*")
