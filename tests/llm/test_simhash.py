"""SimHash against brute force: fingerprints bit by bit, components over all pairs."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import components as components_module
from strandloom.llm import simhash


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 80))]
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append("\t".join(copy) if rnd.random() < 0.2 else " ".join(copy).upper())
    return [*texts, None, "", " \n", "one", "ONE", "é É", texts[0], texts[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, size int").repartition(5)


@pytest.mark.parametrize("radius,tile_rows", [(4, 16), (4, 10_000), (12, 8)])
def test_components_equal_brute_force(docs, radius, tile_rows):
    fp = {3 * i: plain_fingerprint(t, 4) for i, t in enumerate(corpus())}
    want = plain_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= radius)
    got = simhash.near_duplicates(docs, radius=radius, tile_rows=tile_rows).collect()
    assert {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in got} == {i: (fp[i], want[i]) for i in fp}
    assert len(got) == len(fp)


def test_dense_group_and_small_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    values = sorted({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(900)} | {rnd.getrandbits(64) for _ in range(300)})
    monkeypatch.setattr(simhash, "HELD_LINKS", 500)
    a = np.array(values, dtype=np.uint64).reshape(-1, 1)
    order, at = simhash.leaves(simhash.parts(a), 16)
    assert sorted(order.tolist()) == list(range(len(a))) and len(at) > 20
    a = a[order]
    ones = np.ones(len(a), dtype=np.int32)
    tile = simhash.Tile(0, (0, 0), (1, 1), ones, ones, a, ones, np.arange(len(a)), at)
    u, v = simhash.forest(len(a), simhash.near_rows(tile, tile, True, (simhash.Radius(math.inf, 4, 4),), 0.0, 1))
    label = simhash.contracted(len(a), u, v)
    near = np.bitwise_count(a ^ a.T) <= 4
    i, j = np.nonzero(near)
    assert np.array_equal(label, simhash.contracted(len(a), i, j))
    assert len(u) < len(a)


def test_wide_fingerprints_find_similar_sets(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(30):
        words = [f"x{rnd.randrange(5000)}" for _ in range(300)]
        near = list(words)
        near[150] = "changed"
        far = words[:150] + [f"y{rnd.randrange(5000)}" for _ in range(150)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=8, radius=94, first_radius=22, least_ratio=0.8, distinct=True)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert all(got[10 * k] == got[10 * k + 1] == 10 * k and got[10 * k + 2] == 10 * k + 2 for k in range(30))


def test_empty_table_and_null_ids(spark, docs):
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "lone text of its own here")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(rows).collect()) == [(-1, -1), (-1, 5), (5, 5)]


def test_rows_without_an_id_link_like_any_other(spark):
    """Repeated ids with different texts, and a chain whose middle has no id; small tiles and blocks."""
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(20)]), " ".join(rnd.choice(["a", "b", "c"]) for _ in range(rnd.randint(0, 9)))) for _ in range(150)]
    rows += [(None, None), (3, None), (2, "a b c d"), (2, "a b c d")]
    fp = [plain_fingerprint(t, 4) for _, t in rows]
    place = plain_components(list(range(len(rows))), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 20)
    least = {}
    for i, c in place.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, math.inf), rows[i][0])
    want = sorted((str(rows[i][0]), fp[i], str(least.get(c))) for i, c in place.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(docs, radius=20, tile_rows=4).collect()
    assert sorted((str(r.doc_id), int.from_bytes(r.fp, "big"), str(r.component_id)) for r in got) == want


def test_blocks_of_tiles_compare_each_pair_once(docs, monkeypatch):
    monkeypatch.setattr(simhash, "UNITS_A_CORE", 1)
    seen, plain = [], math.isqrt
    monkeypatch.setattr(simhash.math, "isqrt", lambda n: seen.append(n) or max(3, plain(n)))
    fp = {3 * i: plain_fingerprint(t, 4) for i, t in enumerate(corpus())}
    want = plain_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 6)
    got = simhash.near_duplicates(docs, radius=6, tile_rows=4).collect()
    assert seen and {r.doc_id: r.component_id for r in got} == want


def test_hot_fingerprints_are_attached(spark):
    rows = [(i, "" if i % 3 else f"text {i} of its own kind", 5) for i in range(900)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert len(got) == 900 and all(got[i] == 1 for i in range(900) if i % 3)


def test_very_long_text(spark):
    words = [f"w{k % 7919}" for k in range(400_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 3_000_000), (3, " ".join(words[:-1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert int.from_bytes(got[1].fp, "big") == plain_fingerprint(" ".join(words), 4) and got[3].component_id == 1
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("rows", [5, 40, 1000])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, rows):
    monkeypatch.setattr(components_module, "ROWS", rows)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components_module.components(spark.createDataFrame(links, "u long, v long"), len(links)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200, 202: 200}
    none = spark.createDataFrame([(4, 4)], "u long, v long")
    assert components_module.components(none, 1).count() == 0


def test_majority_over_many_rows():
    h = np.random.default_rng(1).integers(0, 2**64, (1000, 3), dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(1000, 3, 8), axis=2, bitorder="little").sum(axis=0, dtype=int)
    got = simhash.majority(h)
    assert [int(g) for g in got] == [sum(1 << b for b in range(64) if 2 * bits[w, b] > 1000) for w in range(3)]


def test_spark_hash_agrees(spark):
    r = spark.createDataFrame([("aé b c d",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert r.h % 2**64 == int(simhash.shingle_hashes("aé b c d".encode().split(), 4)[0])
