import hashlib
import random
import re

from orbitweave.llm.pii import KINDS, SpanModel, estimate_reliabilities, masked, personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    spans = [(m.start(), KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]
    return ",".join(f"{KINDS[r]}:{a}:{b}" for a, r, b in sorted(spans))


def luhn(rng, n=16):
    body = [rng.randrange(10) for _ in range(n - 1)]
    return next(s for c in range(10) if good("card", s := "".join(map(str, [*body, c]))))


def texts():
    rng = random.Random(6)
    out = [None, "", "a@b.c.", "x@y", "..@a-.b_c@d.e", "a@b.c@d.e f", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.255", "1.2.3.4" * 3, "9" * 5000, "a" * 20000 + "@", "7-7 " * 3000, "é🙂 +1 (017) 555-7713🙂", "+12 ", "+1" + "(" * 3000]
    out += ["key " + luhn(rng) + ", " + " ".join(luhn(rng)[i : i + 4] for i in (0, 4, 8, 12)) + " " + luhn(rng, 12) + "-" + luhn(rng, 19)]
    alphabet = ["1", "2", "255", ".", "-", " ", "+1", "@", "a", "b.c", "(", ")", "_", "é", "\n", "4111 1111 1111 1111", "q@x.yz"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    return out


def test_base_matches_plain(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a@b.cd", "x"), (2, "a@b.c.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = []
    for d, t, _ in rows:
        base = plain_base(t)
        want.append((d, *[len(re.findall(rf"\b{k}:", base)) for k in PLAIN], hashlib.sha256(base.encode()).hexdigest()))
    got = sorted((tuple(r)[:6] for r in personal_data(docs).collect()), key=key)
    assert got == sorted(want, key=key)


def secrets_corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = " ".join(rng.choice(["the", "cat", "sat", "on"]) for _ in range(20))
        if i % 3 == 0:
            words += f' token = "{rng.getrandbits(160):040x}" and so on'
        elif i % 3 == 1:
            words += " see long-running-project-name-2 or https://example.org/some/path/to/page12"
        rows.append((i, words))
    return rows


def test_the_method_adds_secrets_and_leaves_the_rest(spark):
    rows = secrets_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in personal_data(docs).collect():
        text = rows[r.doc_id][1]
        if r.doc_id % 3 == 0:
            kind, a, b = r.spans.split(":")
            assert kind == "secret" and re.fullmatch("[0-9a-f]{40}", text[int(a) : int(b)])
        else:
            assert r.spans == ""


def test_columns_of_any_name_ride_along(spark):
    names = ["row", "__text", "__base", "__more", "__spans", "__done", "n_email", "spans"]
    docs = spark.createDataFrame([(1, "a@b.cd x", *names), (None, None, *names), (1, "a@b.cd x", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = masked(docs)
    assert got.columns == docs.columns and sorted(map(str, (r.text for r in got.collect()))) == ["None", "[EMAIL] x", "[EMAIL] x"]
    assert sorted(r.n_email for r in personal_data(docs).collect()) == [0, 1, 1]
    assert masked(docs.limit(0)).collect() == []


def test_masked_texts(spark):
    rows = [*secrets_corpus(), (500, "é mail a.b@c.de, 10.0.0.1 and +1 (017) 555-7713!"), (501, None), (502, "nothing")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in masked(docs).collect()}
    assert got[500] == "é mail [EMAIL], [IP] and [PHONE]!" and got[501] is None and got[502] == "nothing"
    assert got[0].endswith('token = "[SECRET]" and so on') and got[1] == rows[1][1]
    assert masked(docs).columns == docs.columns


def test_em_finds_the_reliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = [truth if rng.random() < p else not truth for p in (0.95, 0.9, 0.6)]
        key = ",".join("1" if v else "-1" for v in votes)
        counts[key] = counts.get(key, 0) + 1
    belief, tables, prior = estimate_reliabilities(counts)
    assert abs(prior - 0.3) < 0.08 and tables[0]["1"][0] > tables[2]["1"][0]
    assert belief["1,1,-1"] > 0.5 > belief["-1,-1,1"]
    assert estimate_reliabilities({})[0] == {}


def test_empty_table(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert SpanModel(-1.0, {}).weights == {}
