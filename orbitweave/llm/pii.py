"""Personal data by weak supervision (operator 7), in DataFrame functions only.

Base kinds are found by fixed patterns. Looser patterns yield candidates, on which regex, gazetteer and context labelers
vote; expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and its
posteriors train a naive Bayes classifier on the candidates' looks, which decides what is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, and the patterns of the base kinds. Look-behinds and possessive repeats match what
#: the plain patterns match, but read a long run of characters once.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Candidates: long mixed tokens, numbers grouped like telephone and identity numbers, spelled-out addresses.
SECRET = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+){1,4}"
CANDIDATE = "|".join((SPELLED, ID, LOCAL_PHONE, SECRET))

#: Gazetteers: names by which such data are introduced, prefixes that issuers give keys, and common top-level names.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "bearer", "auth", "credential")
PHONE_NAMES = ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "sms")
ID_NAMES = ("ssn", "social security", "tax id", "passport", "national id")
KEY_PREFIX = r"^(?:ghp_|gho_|sk-|pk_|rk_|AKIA|ASIA|xox[abp]-|AIza|eyJ|glpat-)"
TOP_LEVEL = r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"

#: Characters before a candidate that its context covers, and the posterior from which a span is added.
CONTEXT = 32
ACCEPT = 0.5
EM_ROUNDS = 60
BLOCK = 256


def _add(total: Column, x: Column) -> Column:
    return total + x


def with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """``df`` with array ``out`` of (start, end, found): leftmost non-overlapping matches, in code points."""
    hits, pieces, steps, sums = (f"__{out}_{x}" for x in ("hits", "pieces", "steps", "sums"))
    zero = F.lit(0)
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), zero))
    df = df.withColumn(pieces, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(steps, F.transform(hits, lambda h, i: F.length(F.get(F.col(pieces), i)) + F.length(h)))
    df = df.withColumn(sums, F.transform(F.sequence(zero, F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), zero, _add)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    upto = lambda i: F.aggregate(F.slice(sums, 1, block(i)), zero, _add) + F.aggregate(F.slice(steps, block(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK))), zero, _add)
    df = df.withColumn(
        out,
        F.transform(hits, lambda h, i: F.struct((upto(i) + F.length(F.get(F.col(pieces), i))).alias("start"), (upto(i) + F.get(F.col(steps), i)).alias("end"), h.alias("found"))),
    )
    return df.drop(hits, pieces, steps, sums)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of a card number pass the check sum."""
    n = F.length(x)

    def worth(i: Column) -> Column:
        d = F.substring(x, n - i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), _add), F.lit(10)) == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, text (null: empty) and base: array of (start, rank, end), in order."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    for kind, pattern in BASE.items():
        df = with_matches(df, "__text", pattern, f"__{kind}")

    def span(kind: str) -> Column:
        valid = F.filter(f"__{kind}", lambda x: _valid(kind, x["found"]))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))

    merged = F.sort_array(F.concat(*[span(k) for k in BASE]))
    return df.withColumn("__base", F.explode(F.array(merged))).drop(*[f"__{k}" for k in BASE])


def _before(text: str, start: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0))
    return F.substring(F.col(text), first + 1, start - first)


def _names(names: tuple[str, ...]) -> str:
    return r"(?i)(?:" + "|".join(names) + r")[^A-Za-z0-9]{0,6}$"


def _kind(found: Column) -> Column:
    """Rank of a candidate's kind by its form."""
    rank = lambda k: F.lit(KINDS.index(k))
    return (
        F.when(found.rlike(f"^(?:{SPELLED})$"), rank("email")).when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), rank("id"))
        .when(found.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), rank("phone")).otherwise(rank("secret"))
    )


def _votes(rank: Column, found: Column, before: Column) -> list[Column]:
    """What each labeler says: 1 for personal data, -1 against, 0 nothing."""
    secret = rank == KINDS.index("secret")
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(found, "")))
    return [
        # regex labelers
        vote(secret & found.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"), secret & found.rlike("[-_/]{2}|^[0-9]+$|^[A-Za-z]+[0-9]{1,2}$")),
        vote(secret & (distinct >= 12) & (F.length(_digits(found)) >= 4), secret & (distinct < 8)),
        vote(~secret & ~found.rlike(r"^\(?[0-9]{3}\)?[\x20.-]0{3}|^(?:000|666|9)[0-9]*-[0-9]{2}-"), ~secret & found.rlike("^0+|([0-9])\\1{5}")),
        # gazetteer labelers
        vote(secret & found.rlike(KEY_PREFIX), secret & found.rlike("/[A-Za-z]+/|^[A-Za-z]+(?:-[A-Za-z]+){2}")),
        vote((rank == KINDS.index("email")) & found.rlike(TOP_LEVEL)),
        # context labelers
        vote(F.when(secret, before.rlike(_names(SECRET_NAMES))).when(rank == KINDS.index("phone"), before.rlike(_names(PHONE_NAMES))).when(rank == KINDS.index("id"), before.rlike(_names(ID_NAMES))).otherwise(F.lit(False))),
        vote(secret & before.rlike("[=:]\\s?[\"']?$"), before.rlike("(?:https?://|www\\.|/)[^\\s\"']*$")),
    ]


def _looks(rank: Column, found: Column, before: Column) -> Column:
    """Features of a candidate, as strings name=value."""
    n = F.length(found)
    bucket = lambda name, x: F.concat(F.lit(f"{name}="), x.cast("string"))
    return F.array(
        bucket("kind", rank),
        bucket("length", F.least(F.floor(n / 8), F.lit(10))),
        bucket("digits", F.floor(4 * F.length(_digits(found)) / n)),
        bucket("capitals", F.floor(4 * F.length(F.regexp_replace(found, "[^A-Z]", "")) / n)),
        bucket("distinct", F.least(F.floor(F.size(F.array_distinct(F.split(found, ""))) / 4), F.lit(8))),
        bucket("signs", F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(5))),
        bucket("before", F.when(before == "", "none").when(before.rlike("[\"'`]$"), "quote").when(before.rlike("[=:]\\s*$"), "sign").when(before.rlike("[A-Za-z]\\s*$"), "letter").otherwise("other")),
        bucket("named", before.rlike(_names(SECRET_NAMES + PHONE_NAMES + ID_NAMES))),
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds __more: array of (start, rank, end, votes, looks) of candidates that no base span overlaps."""
    df = with_matches(df, "__text", CANDIDATE, "__found")
    free = F.filter("__found", lambda x: ~F.exists(F.col("__base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn("__seen", F.transform(free, lambda x: F.struct(x["start"].alias("start"), _kind(x["found"]).alias("rank"), x["end"].alias("end"), x["found"].alias("found"), _before("__text", x["start"]).alias("before"))))

    def judged(x: Column) -> Column:
        votes = F.concat_ws(",", *[v.cast("string") for v in _votes(x["rank"], x["found"], x["before"])])
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), votes.alias("votes"), _looks(x["rank"], x["found"], x["before"]).alias("looks"))

    return df.withColumn("__more", F.explode(F.array(F.transform("__seen", judged)))).drop("__found", "__seen")


@dataclass(frozen=True)
class SpanModel:
    """Log odds of a candidate: a constant and a weight by feature; reliabilities[labeler][vote] by class."""

    constant: float
    weights: dict[str, float]
    reliabilities: tuple[dict[str, tuple[float, float]], ...] = ()


def estimate_reliabilities(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]], float]:
    """EM over counted vote patterns: P(personal | pattern), by labeler P(vote | personal, not), and the prior.

    Begins at the majority of the votes. There are at most 3 ^ labelers patterns, whatever the corpus.
    """
    patterns = {p: p.split(",") for p in counts}
    belief = {p: min(max(0.5 + 0.3 * sum(map(int, v)), 0.05), 0.95) for p, v in patterns.items()}
    tables: list[dict[str, tuple[float, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        total = sum(counts.values())
        yes = sum(counts[p] * belief[p] for p in counts)
        prior = (yes + 1) / (total + 2)
        tables = []
        for k in range(len(next(iter(patterns.values()), []))):
            table = {}
            for vote in ("-1", "0", "1"):
                a = sum(counts[p] * belief[p] for p, v in patterns.items() if v[k] == vote)
                b = sum(counts[p] * (1 - belief[p]) for p, v in patterns.items() if v[k] == vote)
                # the prior counts keep a vote for from ever speaking against
                table[vote] = ((a + (2 if vote == "1" else 1)) / (yes + 4), (b + (2 if vote == "-1" else 1)) / (total - yes + 4))
            tables.append(table)
        after = {p: 1 / (1 + (1 - prior) / prior * math.exp(sum(math.log(t[x][1] / t[x][0]) for t, x in zip(tables, v, strict=True)))) for p, v in patterns.items()}
        moved = max((abs(after[p] - belief[p]) for p in counts), default=0)
        belief = after
        if moved < 1e-9:
            break
    return belief, tables, prior


def fit(docs: DataFrame) -> SpanModel:
    """The span classifier of ``docs``' own candidates; without any, one that adds nothing."""
    found = with_candidates(base_spans(docs.select("text"), [])).select(F.explode("__more").alias("x"))
    each = found.select(F.explode(F.concat("x.looks", F.array(F.lit("")))).alias("look"), F.col("x.votes").alias("votes"))
    table = each.groupBy("look", "votes").count().collect()  # looks times 3 ^ labelers at most, whatever the corpus
    counts = {r.votes: r["count"] for r in table if not r["look"]}
    if not counts:
        return SpanModel(-1.0, {})
    belief, tables, prior = estimate_reliabilities(counts)
    features: dict[str, list[float]] = {}
    for r in sorted(table, key=lambda r: (r["look"], r.votes)):
        if r["look"]:
            both = features.setdefault(r["look"], [0.0, 0.0])
            both[0] += r["count"] * belief[r.votes]
            both[1] += r["count"] * (1 - belief[r.votes])
    yes = sum(n * belief[v] for v, n in counts.items())
    no = sum(counts.values()) - yes
    weights = {f: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for f, (a, b) in features.items()}
    return SpanModel(math.log(prior / (1 - prior)), weights, tuple(tables))


def find(docs: DataFrame, model: SpanModel, keep: list[str], accept: float = ACCEPT) -> DataFrame:
    """``keep`` columns, __text, __base and __spans: base and added spans as (start, rank, end), in order."""
    df = with_candidates(base_spans(docs, keep))
    if model.weights:
        weights = F.create_map(*[F.lit(x) for pair in model.weights.items() for x in pair])
        odds = lambda x: F.aggregate(x["looks"], F.lit(model.constant), lambda s, f: s + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
        added = F.transform(F.filter("__more", lambda x: odds(x) >= math.log(accept / (1 - accept))), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
        spans = F.sort_array(F.concat("__base", added))
    else:
        spans = F.col("__base")
    return df.withColumn("__spans", F.explode(F.array(spans))).drop("__more")


def _written(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) by row of ``docs`` (doc_id, text).

    The counts and the digest are of the base spans. Null text: as empty, so no spans and the digest of an empty string.
    Other columns are not read; repeated rows and null ids pass through; an empty table gives no rows.
    """
    found = find(docs, fit(docs), ["doc_id"], accept)
    count = lambda kind: F.size(F.filter("__base", lambda x: x["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_written("__base"), 256).alias("base_sha256"), _written("__spans").alias("spans"))


def masked(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with each span of the text replaced by its kind in brackets; a null text stays null.

    Repeated rows and null ids pass through; an empty table gives no rows. The caller's columns ride in one struct, so
    that no name of theirs can clash.
    """
    found = find(docs.select(F.struct("*").alias("row"), "text"), fit(docs), ["row"], accept)
    name = F.array(*[F.lit(k.upper()) for k in KINDS])
    # (end so far, pieces): what lies between spans, and a mark for each span that reaches beyond the last
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(so_far: Column, x: Column) -> Column:
        between = F.substring(F.col("__text"), so_far["at"] + 1, F.greatest(x["start"] - so_far["at"], F.lit(0)))
        mark = F.when(x["start"] >= so_far["at"], F.concat(between, F.lit("["), F.get(name, x["rank"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(so_far["at"], x["end"]).alias("at"), F.concat(so_far["out"], F.array(mark)).alias("out"))

    done = found.withColumn("__done", F.aggregate("__spans", start, step))
    text = F.concat(F.array_join("__done.out", ""), F.substring(F.col("__text"), F.col("__done.at") + 1, F.length("__text")))
    masked_text = F.when(F.size("__spans") > 0, text).otherwise(F.col("row.text")).alias("text")
    return done.select(*[masked_text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
