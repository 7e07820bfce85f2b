"""The pipeline's near-duplicates against exact similarities of all pairs of shingle sets."""

import random

import pytest

from strandloom.llm import simhash
from tests.llm.test_simhash import plain_components


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    x, y = plain_set(a), plain_set(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def corpus():
    rnd = random.Random(3)
    prose = lambda n: [f"w{rnd.randrange(9000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        short, long = prose(8), prose(74)
        texts += [short, [*short, *prose(1)]]  # 4 shingles of 5: 0.8, 96 bits apart as expected
        texts += [long, [*long[10:], *prose(10)]]  # 60 shingles of 80: 0.75
        texts += [b := prose(rnd.randint(1, 60)), [*b[rnd.randint(0, 4) :], *prose(rnd.randint(0, 6))]]
    return [*map(" ".join, texts), None, "", " ", "ONE two", "one TWO", " ".join(texts[0]).upper()]


@pytest.mark.parametrize("tile_rows", [None, 16])
def test_links_are_those_of_the_exact_similarity(spark, tile_rows):
    texts = corpus()
    want = plain_components(list(range(len(texts))), lambda i, j: near(texts[i], texts[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = simhash.similar_documents(docs, tile_rows=tile_rows).collect()
    assert len(got) == len(texts) and {r.doc_id: r.component_id for r in got} == want
    kept = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert kept == set(want.values())


def test_no_pairs_and_no_ids(spark):
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (7, "x y z"), (9, "a b c d e f g h i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.similar_documents(docs).collect()  # 4 of 5 shingles are 0.8
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, 9), (-1, 9), (7, 7), (9, 9)]
    assert simhash.similar_documents(docs.where("false")).count() == 0


def test_a_large_group_costs_rows_in_proportion(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(9000)}" for _ in range(200)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(200)]
    made = []
    plain = simhash.verified

    def counted(found, sets):
        links = plain(found, sets)
        made.append((found.count(), links.count()))
        return links

    monkeypatch.setattr(simhash, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_documents(docs, tile_rows=32).collect()} == {0}
    tile_pairs, links = made[0]
    assert tile_pairs <= 8 * 9 // 2 and links <= tile_pairs * 64


def test_rows_are_told_apart_by_id_and_text(spark):
    """Repeated ids, near copies under one id, repeated rows, ties, nulls and a column that cannot be compared."""
    long, near_long, other = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m o", "q r s t u v w x y z"
    rows = [(1, long, {"k": 1}), (5, long, {"k": 2}), (5, other, {"k": 3}), (6, "p1 p2 p3 p4 p5 p6 p7 p8", {}), (6, "p1 p2 p3 p4 p5 p6 p7 p8 p9", {}),
            (None, other, {}), (8, near_long, None), (None, "lone words without an id", {"k": 4}), (None, "lone words without an id", {"k": 4}), (9, None, {}), (10, "", {}), (2, None, {"z": 1}), (2, None, {"z": 1}), (2, None, {"a": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_doc_id map<string,int>").repartition(4)
    kept = simhash.one_of_each_group(docs)
    assert kept.schema == docs.schema
    got = sorted((str(r.doc_id), r.text, str(r.own_doc_id)) for r in kept.collect())
    assert [g for g in got if g[0] not in "6"] == sorted(
        [("1", long, "{'k': 1}"), ("5", other, "{'k': 3}"), ("None", "lone words without an id", "{'k': 4}"), ("2", None, "{'a': 1}")], key=lambda r: (r[0], r[1] or "")
    )
    assert len([g for g in got if g[0] == "6"]) == 1


def test_hot_copies_and_repeated_rows(spark):
    rows = [(i if i % 2 else 4, f"text number {i} alone here now" if i % 5 == 0 else "the same words for most of the rows", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    want = plain_components(list(range(600)), lambda i, j: near(rows[i][1], rows[j][1]))
    kept = simhash.one_of_each_group(docs).collect()
    assert len(kept) == len(set(want.values())) == 121 and {r.doc_id for r in kept if r.text.startswith("the same")} == {1}


def test_sets_of_a_tile_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 50)
    texts = corpus()
    want = plain_components(list(range(len(texts))), lambda i, j: near(texts[i], texts[j]))
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_cuts_have_few_files_however_the_work_is_dealt(spark, monkeypatch):
    """On a local disk each file of a checkpoint starts two processes; with hundreds of tasks a cut they came by the thousand."""
    texts, written = corpus(), []
    plain = simhash.cut

    def listed(df, *files):
        made = plain(df, *files)
        written.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(simhash, "cut", listed)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
        found = simhash.one_of_each_group(docs, tile_rows=8)
        kept, parts = {r.doc_id for r in found.collect()}, found.rdd.getNumPartitions()
        simhash.near_duplicates(docs, tile_rows=8).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == set(plain_components(list(range(len(texts))), lambda i, j: near(texts[i], texts[j])).values())
    assert parts <= 4 * spark.sparkContext.defaultParallelism
    assert len(written) >= 12 and max(written) <= 4 * spark.sparkContext.defaultParallelism and sum(written) <= 5 * len(written), written
