import random
import re

import numpy as np
import xxhash

from orbitweave.llm.simhash import fingerprint, keep_one, near_duplicates, near_edges, plan_parts


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def texts(rng, n=60):
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "delta", "eps", "zeta", "a", "b", "c"]
    out = [None, "", " \t\n ", "one", "one two", "ÀB cd\x0bef", "nb sp x y z", "word " * 3000]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    out += base
    for b in base[:25]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        out += [" ".join(w), b]
    return out


def test_fingerprint_matches_plain():
    for t in texts(random.Random(1)):
        assert fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(random.Random(2)))]
    rows += [rows[9], (None, rows[10][1], "x", 1), (None, "nobody else has this text at all here", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps)
    assert got == sorted((r[0] if r[0] is not None else -1, f"{f:016x}", c) for r, f, c in zip(rows, fps, want))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_dense_buckets_and_chains_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:  # clusters far larger than a block, links of up to three bits, and chains
        x = int(b)
        for _ in range(150):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
            fps.append(int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for distance in (1, 3):
        from orbitweave.llm.components import components

        roots = {r.u: r.v for r in components(near_edges(df, distance, block=40)).collect()}
        want = plain_components(list(range(len(fps))), fps, distance)
        ours, theirs = {}, {}
        for s, w in zip(signed, want):
            ours.setdefault(roots.get(s, s), set()).add(s)
            theirs.setdefault(w, set()).add(s)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_plan_obeys_the_pigeonhole():
    rng = np.random.default_rng(1)
    skew = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    for sample, total in ((skew, 10**9), (skew, 10**4), (np.zeros(0, np.uint64), 0), (np.zeros(1, np.uint64), 1)):
        for distance in (1, 2, 3):
            plan = plan_parts(sample, total, distance)
            assert sum(t + 1 for _, t in plan) == distance + 1
            assert len({b for p, _ in plan for b in p}) == sum(len(p) for p, _ in plan)
    thresholds = {t for _, t in plan_parts(skew, 10**9, 3)}
    assert thresholds != {0}  # the constant half of the bits isn't probed like the others


def test_keep_one_leaves_one_row_of_each_component(spark):
    other, lone = "other words are here now", "quite another text with its own words in it"
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "x"), (3, "a b c d e", "y"), (9, other, "x"), (None, "a b c d e", "x"), (9, lone, "x"), (None, None, "x"), (None, "", None), (None, " ", "x")]
    names = ["row", "id", "key", "kept_id", "best_id", "best_key", "fp", "root", "lang"]
    docs = spark.createDataFrame([(*r[:2], *[r[2]] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    got = keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == 4 and {(3, "a b c d e"), (9, other), (9, lone)} < set(kept)
    (nobody,) = [t for d, t in kept if d is None]
    assert not (nobody or "").strip()
