import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import mixing
from orbitweave.llm.mixing import DOMAINS, fit_rates, mixed, mixture, with_rates


def plain_descent(p, tokens, share, total, rounds):
    """Plain projected gradient, by the step 1, for as long as it takes."""
    have = p.T @ tokens
    r = np.ones(len(p))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ ((p.T @ (tokens * r) - share * total) / have))
    return r


@pytest.mark.parametrize("spread", [0.3])
def test_rates_fit_at_least_as_well_as_a_long_plain_descent(spark, spread):
    rng = np.random.default_rng(3)
    p = np.round(rng.dirichlet([spread] * 4, 300), 6)
    tokens = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(t), [float(x) for x in row]) for i, (t, row) in enumerate(zip(tokens, p))], "i int, __tokens long, __posterior array<double>")
    targets = {"sound": 0.6, "poor": 0.3, "poor_toxic": 0.1}
    fit = fit_rates(df, targets)
    got = np.array([r.rate for r in with_rates(df, fit).orderBy("i").collect()])
    assert len(got) == 300 and (got >= 0).all() and fit.settled
    share, have = np.array([targets.get(d, 0) for d in DOMAINS]), p.T @ tokens
    miss = lambda r: (p.T @ (tokens * r) - share * have.sum()) / have
    assert abs(np.abs(miss(got)).max() - fit.residual) < 1e-9
    squared = lambda r: (have / have.sum() * miss(r) ** 2).sum()
    assert squared(got) < 1.25 * squared(plain_descent(p, tokens, share, have.sum(), 50_000)) + 1e-9
    assert squared(got) < squared(plain_descent(p, tokens, share, have.sum(), 20_000))


def test_rows_of_hot_posteriors_get_their_rate(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", 5)
    rows = [(i, 10, [0.0, 0.0, 1.0, 0.0] if i % 3 else [0.5, round(0.001 * i, 6), 0.25, 0.1]) for i in range(100)] + [(i, 10, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 103)]
    df = spark.createDataFrame(rows, "i int, __tokens long, __posterior array<double>").repartition(3)
    fit = fit_rates(df, {"sound": 0.5, "poor": 0.5})
    rates = {tuple(r["__posterior"]): r.rate for r in fit.rates.collect()}
    assert mixing.hot_keys_of(fit.rates).count() == 1
    got = {r.i: r.rate for r in with_rates(df, fit).collect()}
    assert got == {i: rates[tuple(v)] for i, _, v in rows}


def test_rounds_that_do_not_suffice_are_told(spark):
    p = np.round(np.random.default_rng(4).dirichlet([1.0] * 4, 200), 6)
    df = spark.createDataFrame([(10, [float(x) for x in row]) for row in p], "__tokens long, __posterior array<double>")
    with pytest.warns(UserWarning, match="did not settle in 3 rounds"):
        fit = fit_rates(df, {"sound": 1.0}, rounds=3)
    assert not fit.settled and fit.residual > 0.1


def corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        poor, toxic = i % 4 == 0, i % 5 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + (rng.choice(["###", "%%%"]) if poor else "") for _ in range(rng.randint(20, 90))]
        if toxic:
            words[3] = "nasty"
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2:
            labels.append((i, 0 if poor else 1, int(toxic)))
        elif i < 200:
            labels.append((i, 0 if poor else 1, int(toxic)))
    rows += [(1000, None, "en", None), (1001, "", "en", "s"), (None, "alpha beta", "en", "s"), (7, rows[7][1], "en", "s")]
    labels += [(5, None, 1), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, copies string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_mixture_meets_targets_in_expectation(spark):
    docs, labels, rows = corpus(spark)
    out = mixture(docs, labels).toPandas()
    assert len(out) == len(rows) and (out.rate >= 0).all()
    p = out[[f"p_{d}" for d in DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    share = (p * (out.n_tokens * out.rate).to_numpy()[:, None]).sum(axis=0) / out.n_tokens.sum()
    assert np.allclose(share, [0.08, 0.02, 0.85, 0.05], atol=0.01)
    best = {r.doc_id: DOMAINS[int(np.argmax(q))] for r, q in zip(out.itertuples(), p)}
    assert np.mean([best[i] == ("poor" if i % 4 == 0 else "sound") + ("_toxic" if i % 5 == 0 else "") for i in range(300)]) > 0.9
    assert abs(out.copies.sum() - out.rate.sum()) < 40


def test_mixed_keeps_columns_and_the_whole_domain(spark):
    docs, labels, rows = corpus(spark)
    out = mixed(docs, labels, whole="sound")
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {i for i in range(300) if i % 4 and i % 5} <= ids


def test_columns_of_any_name_ride_along(spark):
    docs, labels, rows = corpus(spark)
    names = ["row", "copy", "__tokens", "__posterior", "__looks", "__words", "__copies", "domain", "tokens", "at"]
    wide = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    out = mixed(wide, labels, whole="sound")
    assert out.columns == wide.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in mixed(docs, labels, whole="sound").collect())))
    assert mixture(wide, labels).count() == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixture(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = mixture(one, labels).first()
    assert row.p_poor == 0.25 and row.n_tokens == 3
