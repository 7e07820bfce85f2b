"""Substring dedup against brute force over all windows."""

import random

import numpy as np
import pytest

from strandloom.llm import substring_dedup as sd


def plain(rows):
    seen = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - 12):
            if doc is not None:
                key = tuple(words[i : i + 13])
                seen[key] = min(seen.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(words) - 12):
                if seen[tuple(words[i : i + 13])] < doc:
                    gone.update(range(i, i + 13))
        out.append((doc, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def corpus(seed=6):
    rnd = random.Random(seed)
    vocab = ["a", "b", "é", "日本", "w\xa0x", "Ünd"] + [f"v{i}" for i in range(30)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 13, 14, 20, 45]))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += [rnd.choice(vocab) for _ in range(rnd.randint(0, 20))]
            if rnd.random() < 0.6:
                words += rnd.choice(passages)
        rows.append((rnd.randrange(10_000), rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [rows[3], (rows[4][0], rows[5][1]), (50, "z " * 60), (51, "z " * 40), (None, rows[0][1]), (7, None), (8, "")]
    rows += [(20_000 + i, " ".join(passages[4]) + f" tail{i}") for i in range(60)]
    return rows


@pytest.mark.parametrize("shard_bytes", [1, 700, 1 << 30])
def test_equals_brute_force(spark, shard_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, hashes string").repartition(4)
    got = sd.dedup(docs, shard_bytes=shard_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain(rows), key=key)


def test_cover_meets_every_pair_of_offsets():
    cover = set(sd.COVER)
    assert all(any((i + d) % sd.PERIOD in cover and (j + d) % sd.PERIOD in cover for d in range(sd.PERIOD)) for i in range(sd.PERIOD) for j in range(sd.PERIOD))
    assert sd.PERIOD - 1 + sd.ANCHOR == sd.WINDOW


def test_windows_around_anchors():
    words = sd.Words(" ".join("abcdefghijklmnopqrst"))
    for p in range(words.n - sd.ANCHOR + 1):
        want = [s <= p and p + sd.ANCHOR <= s + sd.WINDOW for s in range(words.n - sd.WINDOW + 1)]
        assert words.around(np.array([p])).tolist() == want


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_messages_round_trip():
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 2**64, 50, dtype=np.uint64)
    assert np.array_equal(sd.unpacked(sd.packed(hashes)), hashes & sd._UPPER)
    for ids in (np.array([7]), np.array([-5, 3, 2**32 - 6]), np.array([-(2**63), 2**63 - 1, 0]), np.array([2**40, 2**40 + 9])):
        assert sd.unpacked_ids(sd.packed_ids(ids), len(ids)).tolist() == ids.tolist()
