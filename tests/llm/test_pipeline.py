"""The pipeline's stages keep their promises, and run equals a plain version of the stages."""

import random

import pytest

import corpus_pipeline
from tessera.llm import bpe, mixing, pii, simhash, toxicity
from tessera.llm.common import read

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "source_mixing", "bpe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vile", "awful"])
        if i % 10 == 1:
            words[5] = "a.86@mail8.example.com"
        rows.append((i, " ".join(words), "en", "big" if i % 5 else "small", 1, int(toxic)))
    clean = [r for r in rows if not r[5]]
    rows += [(1000 + r[0], r[1], *r[2:]) for r in clean[:20]]
    rows += [(2000, None, None, None, None, 0), (2001, "", "en", "big", 0, 0), (None, "a text without id", "en", "small", 1, 0)]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows if r[0] is not None and r[0] < 300], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_against_the_stages_decisions(spark, folder):
    docs = read(spark, folder, "documents")
    model = toxicity.fit(docs, toxicity.learnable(read(spark, folder, "labels")))
    table = toxicity.Rows(model.rows)
    rows = [r for r in docs.collect() if model.scores([toxicity.word_rows((r["text"] or "").encode(), table)])[0] < 0.5]
    ids = {r["doc_id"] for r in rows}
    assert sum(i not in ids for i in range(0, 300, 4)) > 60 and sum(i in ids for i in range(300) if i % 4) > 210
    seen: list[int] = []
    kept = []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        fp = simhash.fingerprint((r["text"] or "").encode())
        if all(bin(fp ^ f).count("1") > 4 for f in seen):
            kept.append(r)
            seen.append(fp)
    names = pii.Pseudonyms(pii.DEMONSTRATION_KEY)
    texts = {r["doc_id"]: (names.replace(r["text"].encode())[0].decode() if r["text"] else "") for r in kept}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    own = bpe.BytePairs(open(bpe.default_path(), encoding="utf-8").read())
    for r in got:
        assert r["text"] == texts[r["doc_id"]] and r["ids"] == own.encode(r["text"]) and r["n_tokens"] == len(r["ids"])
    total = lambda s: sum(len(texts[r["doc_id"]].split()) for r in kept if (r["source"] or "") == s)
    emitted = lambda s: sum(len(r["text"].split()) for r in got if (r["source"] or "") == s)
    assert emitted("big") == total("big")
    assert 1.8 * total("small") <= emitted("small") <= 2 * total("small")
    assert mixing.Mix(max_repetition=2.0) == corpus_pipeline.MIX


@pytest.mark.parametrize("k", range(5))
def test_stages_alone(spark, folder, k):
    """Each stage on the raw documents, and on none of them."""
    docs = read(spark, folder, "documents")
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    assert out.columns[:5] == COLUMNS and (k == 4 or out.columns == COLUMNS)
    assert out.count() > 0
    assert stage(spark, docs.limit(0), folder).count() == 0
