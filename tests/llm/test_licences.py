import random
import time

import pytest

from orbitweave.llm.licences import DICE, NOTICES, Scanner, bigrams, dice, licence_scan, normalised, templates


def plain(text, least=DICE):
    """All runs of lines, then all runs of words, against all templates."""
    lines = [normalised(x) for x in text.split("\n")]
    found = []
    for name, t in NOTICES.items():
        b = bigrams(normalised(t))
        flat = [(w, i) for i, x in enumerate(lines) for w in x]
        pairs = [(i, j) for (v, i), (w, j) in zip(flat, flat[1:]) if (v, w) in b]
        begins, ends = {i for i, _ in pairs}, {j for _, j in pairs}
        for i in begins:
            for j in range(i, len(lines)):
                run = bigrams(sum(lines[i : j + 1], []))
                if j in ends and (d := dice(run, b)) >= least:
                    found.append((-len(run & b) * d, i, j - i + 1, name, d))
    words = sum(lines, [])
    line_of = [i for i, x in enumerate(lines) for _ in x]
    runs = []  # of words, from one bigram of the template to another
    for name, t in NOTICES.items():
        b = bigrams(normalised(t))
        for a in range(len(words) - 1):
            seen, hits = set(), 0
            for z in range(a + 1, len(words)):
                pair = words[z - 1], words[z]
                hits += pair in b and pair not in seen
                seen.add(pair)
                if z == a + 1 and pair not in b or len(seen) > (2 - least) / least * len(b) + 1:
                    break
                if pair in b and (d := 2 * hits / (len(seen) + len(b))) >= least:
                    runs.append((-hits * d, a, z - a, name, d))
    runs.sort()
    taken, used, out = set(), set(), []
    for _, i, n, name, d in sorted(found):
        if taken.isdisjoint(range(i, i + n)):
            taken.update(range(i, i + n))
            mine = [k for k, line in enumerate(line_of) if i <= line < i + n]
            best = next(((a, a + k) for _, a, k, other, _ in runs if other == name and mine[0] <= a and a + k <= mine[-1]), (mine[0], mine[-1]))
            used.update(range(best[0], best[1] + 1))
            out.append((i, mine[0], name, d, n))
    for _, a, k, name, d in runs:
        if used.isdisjoint(range(a, a + k + 1)):
            used.update(range(a, a + k + 1))
            out.append((line_of[a], a, name, d, line_of[a + k] - line_of[a] + 1))
    return [(name, d, i, n) for i, _, name, d, n in sorted(out)]


def texts():
    rng = random.Random(3)
    vocabulary = sorted({w for t in NOTICES.values() for w in t.split()})
    out = [None, "", "licensed", "Licensed under the Apache License, Version 2.0.", "LICENSED under the\napache licence version 2.0"]
    for name, t in NOTICES.items():
        w = t.split()
        for damage in (0, 1, 3, 12):
            v = [x if rng.random() > damage / len(w) else rng.choice(vocabulary) for x in w]
            cuts = sorted(rng.sample(range(len(v) + 1), min(4, len(v))))
            body = "\n".join(" ".join(v[a:b]) for a, b in zip([0, *cuts], [*cuts, len(v)]))
            out.append(f"before it\n{body}\n\nafter it " + "\n".join(rng.choice(vocabulary) for _ in range(9)))
    return out


def test_scan_matches_all_comparisons(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "Released under the MIT License.", 1), (3, "Released under the MIT License.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, [tuple(m) for m in r.matches], r.n_licences) for r in licence_scan(df, NOTICES).collect())
    assert got == sorted((d if d is not None else -1, plain(t or ""), len(plain(t or ""))) for d, t, _ in rows)
    assert sum(bool(g[1]) for g in got) > 20
    assert licence_scan(df.limit(0)).collect() == []


def test_size_bounds_hold_at_the_threshold():
    s = Scanner(NOTICES, DICE)
    for name, b in s.templates.items():
        low, high = s.sizes[name]
        assert abs(2 * low / (low + len(b)) - DICE) < 1e-9 and abs(2 * len(b) / (high + len(b)) - DICE) < 1e-9


def test_runs_of_many_lines_and_inside_lines_are_found():
    s = Scanner(NOTICES, DICE)
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    for name in ("MIT", "GPL-3.0", "BSD-2-Clause"):
        w = NOTICES[name].split()
        tall = "\n\n".join(w)
        ((found, d, i, n),) = s.scan(f"{own(9)}\n{tall}\n{own(9)}")
        assert (found, d, i) == (name, 1.0, 1) and 1.9 * len(w) < n < 2 * len(w)
        assert s.scan(f"{own(300)} {NOTICES[name]} {own(300)}") == [(name, 1.0, 0, 1)]
    both = f"{own(50)} {NOTICES['MIT-line']} {own(50)} {NOTICES['CC-BY-NC-4.0-line']} {own(50)}"
    assert [m[0] for m in s.scan(both)] == ["MIT-line", "CC-BY-NC-4.0-line"]
    assert [m[0] for m in s.scan(f"{NOTICES['MIT']} {NOTICES['CC-BY-NC-4.0-line']}")] == ["MIT", "CC-BY-NC-4.0-line"]


@pytest.mark.parametrize("name", ["Apache-2.0-text", "BSD-3-Clause", "CC0-1.0-text", "GPL-3.0-text", "MIT-text", "MPL-2.0-text"])
def test_full_texts_are_found_whole_damaged_and_one_word_a_line(name):
    s, rng = Scanner(templates(), DICE), random.Random(7)
    text = templates()[name]
    own = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    vocabulary = sorted(set(text.split()))
    words = [x if rng.random() > 0.04 else rng.choice(vocabulary) for x in text.split()]
    began = time.time()
    for body, sure in ((text, 1.0), ("\n".join(text.split()), 1.0), (" ".join(words[i] + ("\n" if i % 11 == 10 else "") for i in range(len(words))), 0.8)):
        found = s.scan(f"{own(40)}\n{body}\n{own(40)}")
        assert any(m[0] == name and m[1] >= sure for m in found)
    assert time.time() - began < 60


@pytest.mark.parametrize("foreign", [5, 60, 200])
def test_licences_from_inside_one_line_to_inside_another(foreign):
    s, rng = Scanner(templates(), DICE), random.Random(8)
    own = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    for name in ("MIT", "GPL-3.0", "BSD-2-Clause"):
        w = NOTICES[name].split()
        for lines in (2, 3):
            cuts = [len(w) * i // lines for i in range(lines + 1)]
            body = "\n".join(" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:]))
            found = s.scan(f"{own(20)}\n{own(foreign)} {body} {own(foreign)}\n{own(20)}")
            assert [m[0] for m in found] == [name] and found[0][1] > 0.8 and found[0][2:] == (1, lines)
