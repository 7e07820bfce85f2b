"""The pipeline's stages against planted cases and plain restatements, and the registry's promises."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from strandloom.llm import byte_bpe, pii, registry
from tests.llm.test_text_operators import P

VOCAB = [a + b for a in ("ba", "ke", "lo", "mi", "su", "ta", "ve", "no") for b in ("ren", "dos", "gil", "pam", "vek", "zul", "")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        text = prose(rnd, rnd.randint(60, 200))
        if i % 7 == 0:
            words = text.split()
            words[rnd.randrange(len(words)) : 0] = ["idiots", "scum"]
            text = " ".join(words)
        rows.append([i, text, "en", f"s{i % 3}", 0])
        if i % 2:
            labels.append((i, 1, int(i % 7 == 0)))
    clean = [r for r in rows if r[0] % 7]
    items = [(k, prose(rnd, 30)) for k in range(12)]
    for k in range(12):
        rows.append([400 + k, f"{prose(rnd, 80)} {items[k][1]} {prose(rnd, 50)}", "en", "leak", 0])
    for k in range(10):
        rows.append([500 + k, clean[k][1], "en", "copy", 0])
        near = clean[20 + k][1].split()
        near[len(near) // 2] = "altered"
        rows.append([600 + k, " ".join(near), "en", "near", 0])
    rows.append([700, f"{prose(rnd, 60)} write to some.one@mail.example.com or +49 30 12345678", "en", "pii", 0])
    rows += [[701, None, None, None, None], [702, "", "en", "x", 0]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}


def test_stages_one_by_one(spark, tables):
    path, rows = tables
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    schema = docs.schema
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, path)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        if name != "tokens":
            assert docs.schema == schema
    toxic = {i for i in range(0, 300, 7)}
    assert len(toxic & set(kept["toxicity"])) <= 2 and set(rows) - toxic <= set(kept["toxicity"])
    gone = set(kept["toxicity"]) - set(kept["near_duplicates"])
    copies = set(range(500, 510)) | set(range(600, 610))
    assert gone - {701, 702} == copies and len(gone & {701, 702}) == 1
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == set(range(400, 412))
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    for i, r in kept["personal_data"].items():
        text = rows[i][1]
        assert r.text == (text if text is None else pii.masked(text, pii.spans(text)))
        assert r.n_chars == (None if r.text is None else len(r.text)) and (r.lang, r.source) == (rows[i][2], rows[i][3])
    assert "<email>" in kept["personal_data"][700].text and "<phone>" in kept["personal_data"][700].text
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in kept["tokens"].items():
        text = kept["personal_data"][i].text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc[0].encode_ordinary(text) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = {r.doc_id: r.n_tokens for r in cp.run(spark, path).collect()}
    assert whole == {i: r.n_tokens for i, r in kept["tokens"].items()}


def test_edge_cases_pass_all_stages(spark, tmp_path):
    """Nulls, repeated rows and ids, ties, very long texts, columns named like outputs, and no ``n_chars``."""
    rnd = random.Random(2)
    long = prose(rnd, 150_000) + " " * 1_100_000 + "end"
    one = prose(rnd, 40)
    rows = [(1, one, "x", 5, {"a": 1}), (1, one, "x", 5, {"a": 1}), (1, prose(rnd, 40), "x", 5, None), (None, prose(rnd, 30), None, None, {}), (None, one, None, None, {}), (2, None, None, None, {}), (3, "", "y", 1, {}), (4, long, "y", 1, {})]
    path = str(tmp_path)
    schema = "doc_id long, text string, ids string, n_tokens int, component_id map<string,int>"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0), (3, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, one), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = sorted((str(r.doc_id), r.decoded_sha256) for r in cp.run(spark, path).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert out == sorted([("1", digest(one)), ("1", digest(rows[2][1])), ("None", digest(rows[3][1])), ("2", digest("")), ("4", digest(long))])
    docs = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
