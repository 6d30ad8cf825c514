import glob
import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from orbitweave.llm.simhash import fingerprint
from tests.llm.test_quality_rules import plain_kept

SF = "/root/testdata/sf0.001"


def plain_least(rows, distance=3):
    """Ids that are the least of their component, by all pairs."""
    found = [(d, fingerprint(t)) for d, t in rows]
    least = {d: d for d, _ in found}
    changed = True
    while changed:
        changed = False
        for a, x in found:
            for b, y in found:
                if (x ^ y).bit_count() <= distance and least[a] < least[b]:
                    least[b], changed = least[a], True
    return {d for d, m in least.items() if d == m}


def test_each_stage_takes_effect_and_matches_plain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    result = corpus_pipeline.run(spark, SF).collect()
    (folder,) = glob.glob(f"{tmp_path}/pipeline-*")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [docs.collect()] + [spark.read.parquet(f"{folder}/{i}").collect() for i in range(4)]
    for rows in stages[1:]:
        assert rows[0].asDict().keys() == set(docs.columns)
    ids = [[r.doc_id for r in rows] for rows in stages]

    verdicts = plain_kept([(r.doc_id, r.text, r.source) for r in stages[0]])
    assert sorted(ids[1]) == sorted(r.doc_id for r, kept in zip(stages[0], verdicts) if kept)
    assert len(ids[1]) < len(ids[0])

    assert sorted(ids[2]) == sorted(plain_least([(r.doc_id, r.text) for r in stages[1]]))
    assert len(ids[2]) < len(ids[1])

    assert sorted(ids[3]) == sorted(ids[2])
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(email.search(r.text) for r in stages[2]) and not any(email.search(r.text) for r in stages[3])

    assert set(ids[4]) <= set(ids[3])
    texts = {r.doc_id: r.text for r in stages[3]}
    assert all(texts[r.doc_id] == r.text for r in stages[4])

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = sorted((r.doc_id, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()) for r in stages[4] for e in [tokenizer.encode(r.text, add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in result) == want
