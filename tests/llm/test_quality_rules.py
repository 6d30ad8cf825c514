import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from orbitweave.llm import textstats
from orbitweave.llm.quality_rules import cleaned_documents, kept_documents, quality_rules, without_frequent_lines


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {k for g in grams.values() if len(g) > 1 for i in g for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_kept(rows, documents=10, share=0.005, left_share=0.2):
    norm = lambda t: [y for y in (re.sub(r"[ \t\x0b\f\r]+", " ", x).strip(" ") for x in (t or "").lower().split("\n")) if y]
    within, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        if lines := norm(t):
            hosts[s or ""].add(t)
            for x in lines:
                within[s or "", x].add(t)
    above = lambda host, x: (k := len(within[host, x])) > documents and (len(x.split(" ")) >= 20 or k > share * len(hosts[host]))
    out = []
    for _, t, s in rows:
        n, *_, rep = plain_counts(t)
        words = sum(len(x.split(" ")) for x in norm(t))
        gone = sum(len(x.split(" ")) for x in norm(t) if above(s or "", x))
        out.append(not (n < 50 or 100 * rep > 50 * n) and (not words or 1 - gone / words >= left_share))
    return out


def corpus():
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    banner = "Subscribe  NOW to our letter and never miss a thing " + " ".join(f"b{i}" for i in range(45))
    rows = [(i, f"{own(60)}\n{own(30)} #a\n{banner}\n", "site" if i % 3 else None) for i in range(60)]
    rows += [(100 + i, f"{banner}\n{own(8)}", "site") for i in range(3)]  # depleted
    copy, page = own(80) + "\n" + own(70), own(80) + "\n" + own(70)
    rows += [(200 + i, copy, "site") for i in range(40)] + [(300 + i, page + f"\n{i}", "site") for i in range(40)]  # one text; 40 texts with the same lines
    rows += [(400, None, "site"), (401, "", None), (402, " \n \t", "x"), (403, "a b c " * 4000, "x"), (404, own(30) + "\n" + own(30), "x"), (404, own(70), "x")]
    rows += [(None, own(99), "x"), (405, own(20000), "x"), (406, "one two three four " + own(50) + " one two three", "x")]
    rows += [rows[-1]] * 3
    return rows


def test_counts_and_verdicts_match_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, n_words int, host string").repartition(4)
    want = sorted(((d if d is not None else -1, *plain_counts(t), k) for (d, t, _), k in zip(rows, plain_kept(rows))))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality_rules(docs).collect())
    assert got == want
    by_id = {r[0]: r[-1] for r in want}
    assert not by_id[100] and by_id[1] and by_id[200] and not by_id[310]
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept_documents(docs).select("doc_id").collect())
    assert kept == sorted(w[0] for w in want if w[-1])
    assert kept_documents(docs).columns == docs.columns
    clean = {r.doc_id: r.text for r in without_frequent_lines(docs).collect()}
    assert "subscribe" not in clean[1].lower() and clean[200] == rows[63][1]


def test_files_are_judged_as_tables_in_memory(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdicts = plain_kept(rows)
    assert quality_rules(docs).filter("kept").count() == kept_documents(docs).count() == sum(verdicts)
    assert without_frequent_lines(docs).count() == len(rows)


def test_windows_are_told_apart_by_pairs_too(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", textstats.words_of(F.col("text")))
    for bits in (3, 24, 60):  # more places than fit; as in production; hardly a bit of the hash is left, so most clash
        monkeypatch.setattr(textstats, "PLACE_BITS", bits)
        got = {r.text: r.n for r in textstats.with_repeated_words(df, "words", "n").collect()}
        assert got == {t: plain_counts(t)[-1] for t in texts}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules(docs).collect() == []
    assert kept_documents(docs).collect() == []


def test_a_banner_that_is_most_of_each_document_rejects_them(spark):
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    banner, footer = own(300), own(90)
    rows = [(i, f"{banner}\n{own(12)}\n{own(12)}\n{footer}", "site") for i in range(200)] + [(1000 + i, own(60), "site") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in kept_documents(docs).collect()} == {1000 + i for i in range(20)}
    assert all(banner not in r.text and footer not in r.text for r in without_frequent_lines(docs).collect())


def test_columns_of_any_name_ride_along(spark):
    rng = random.Random(5)
    names = ["row", "id", "of", "key", "host", "text_key", "removed_lines", "kept", "n", "words", "removed", "good_id", "__id", "left_share", "salt", "part"]
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(60)), "s", *range(len(names))) for i in range(5)] + [(9, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    for f, n in ((kept_documents, 5), (cleaned_documents, 5), (without_frequent_lines, 6)):
        got = f(docs)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(rows[:n])
    assert quality_rules(docs).count() == 6


def test_a_long_shared_line_does_not_hide_its_documents(spark):
    rng = random.Random(7)
    own = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage = own(80)
    rows = [(i, f"{passage}\n{own(8)}", "site") for i in range(1000)] + [(2000 + i, own(80) + "\n" + own(8), "site") for i in range(20)]
    rows += [(3000 + i, f"{own(70)}\n{passage}", "other") for i in range(5)] + [(4000, passage, "third")] * 30
    kept = {r.doc_id for r in kept_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {r[0] for r in rows[1000:]}


def test_the_pipeline_takes_frequent_lines_out_of_kept_texts(spark):
    import corpus_pipeline

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = corpus_pipeline.quality(spark, docs, "")
    assert found.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "")
    want = [(d, "\n".join(x for x in t.split("\n") if not x.startswith("Subscribe")), s) for (d, t, s), kept in zip(rows, plain_kept(rows)) if kept]
    got = sorted(map(tuple, found.collect()), key=order)
    assert got == sorted(want, key=order) and any("Subscribe" in (t or "") for _, t, _ in rows[:60])


def test_long_lines_have_the_same_limit_in_large_hosts(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage, short = own(60), own(19)
    rows = [(i, f"{passage}\n{own(8)}", "site") for i in range(11)] + [(100 + i, f"{passage}\n{own(8)}", "small") for i in range(10)]
    rows += [(200 + i, f"{short}\n{own(40)}", "site") for i in range(11)] + [(1000 + i, own(55), "site") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in kept_documents(docs).collect()} == {r[0] for r in rows[11:]}
    texts = {r.doc_id: r.text for r in without_frequent_lines(docs).collect()}
    assert passage not in texts[0] and passage in texts[100] and short in texts[200]
