"""Decontamination: planted passages, paraphrases, clean texts, and the parts against plain restatements."""

import random

import numpy as np
import pytest

from strandloom.llm import decontamination as d

VOCAB = [a + b + c for a in ("ba", "ke", "lo", "mi", "su", "ta") for b in ("ren", "dos", "gil", "pam", "vek", "zul") for c in ("", "a", "ist", "on", "em", "ur", "ok", "yl", "int", "asp")]


def prose(rnd, n):
    return [rnd.choice(VOCAB) if rnd.random() < 0.6 else rnd.choice(["the", "of", "and", "to"]) for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(8)
    items = [(i, " ".join(prose(rnd, rnd.choice([14, 25, 40, 60])))) for i in range(40)]
    docs, want = [], set()
    for k in range(300):
        words = prose(rnd, rnd.randint(5, 600))
        if k % 6 == 0:
            item, text = items[rnd.randrange(len(items))]
            part = text.upper().split() if k % 12 == 0 else [w + "!!" for w in text.split()]
            if k % 18 == 0 and len(part) > 20:
                del part[9]  # a paraphrase: a word gone, another put in
                part.insert(15, "extra")
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
            want.add((k, item))
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (903, "one two")]
    want.add((902, 3))
    return items, docs, want


def frames(spark, case):
    items, docs, _ = case
    return (
        spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, cosine double").repartition(4),
        spark.createDataFrame([*items, (100, None), (101, "")], "item_id long, text string"),
    )


def test_planted_passages_are_found_and_nothing_else(spark, case):
    docs, items = frames(spark, case)
    found = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    want = case[2]
    assert len(found & want) >= 0.95 * len(want)
    assert not found - want


def test_rows_without_leaks_keep_their_columns(spark, case):
    docs, items = frames(spark, case)
    kept = d.without_leaks(docs, items)
    assert kept.schema == docs.schema
    held = {k for k, _ in case[2]}
    ids = {r.doc_id for r in kept.collect()}
    assert {k for k, _ in case[1]} - held <= ids
    assert len(ids & held) <= 0.05 * len(held)


def test_blocks_of_items_change_nothing(spark, case, monkeypatch):
    docs, items = frames(spark, case)
    whole = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    left = sorted(r.doc_id for r in d.without_leaks(docs, items).collect())
    monkeypatch.setattr(d, "ITEM_BLOCK", 15)
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == whole
    assert sorted(r.doc_id for r in d.without_leaks(docs, items).collect()) == left


def plain_leaks(items, docs):
    """Pairs that the definition makes leaks, by every stretch of words of a quarter more than the item."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    texts = {k: split(t) for k, t in docs}
    held = {}
    for words in texts.values():
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    found = set()
    for item, text in items:
        own = split(text)
        hashes = {w: int(d.hashed([w])[0][0]) for w in own}
        rare = sorted(set(own), key=lambda w: (held.get(w, 0), hashes[w]))[: d.ANSWER_WORDS]
        n, room, least = len(own), len(own) + len(own) // 4 + 2, min(d.LEAST_ANSWER, len(rare))
        for k, words in texts.items():
            if len(set(rare) & set(words)) < least:
                continue
            for at in range(max(1, len(words) - room + 1)):
                near = words[at : at + room]
                answer = len(set(rare) & set(near))
                if answer >= least:
                    row = [0] * (len(near) + 1)
                    for x in own:
                        before = 0
                        for j, y in enumerate(near, 1):
                            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
                    share = row[-1] / n
                    if share >= d.LCS_ALONE or share >= d.LCS_WITH_ANSWER and answer >= d.ANSWER_SHARE * len(rare):
                        found.add((k, item))
                        break
    return found


def test_search_against_every_stretch_and_every_item(spark):
    """Copies, and paraphrases with words changed, dropped and added, against a complete search without latent vectors or windows."""
    rnd = random.Random(21)
    # A word of its own for each bin, so that document frequencies of bins are those of words.
    vocab, used = [], set()
    for w in (a + b for a in VOCAB for b in ("", "ra", "ti", "mo")):
        b = int(d.bin_of(d.hashed([w])[0])[0])
        if b not in used:
            used.add(b)
            vocab.append(w)
    draw = lambda n: [vocab[min(int(rnd.expovariate(1 / 150)), len(vocab) - 1)] for _ in range(n)]
    items = [(i, " ".join(draw(rnd.choice([10, 14, 25, 40, 60])))) for i in range(30)]
    docs = []
    for k in range(150):
        words = draw(rnd.randint(5, 250))
        if k % 2:
            part = items[rnd.randrange(30)][1].split()
            for _ in range(round(len(part) * rnd.choice([0, 0.1, 0.2, 0.3, 0.45]))):
                at = rnd.randrange(len(part))
                part[at : at + 1] = rnd.choice([[], draw(1), [part[at], *draw(1)]])
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((k, " ".join(words)))
    want = plain_leaks(items, docs)
    found = {(r.doc_id, r.item_id) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 50 and found <= want and len(found) >= 0.95 * len(want), (len(found), len(want))


def test_directions_are_those_of_a_plain_decomposition(spark, case):
    rnd = random.Random(3)
    texts = [" ".join(prose(rnd, rnd.randint(1, 200))) for _ in range(60)]
    idf = np.random.default_rng(1).uniform(0.5, 3, d.BINS)
    rows = []
    for text in texts:
        words = d.bin_of(d.hashed([text])[0])
        for at in range(0, max(1, len(words) - d.PASSAGE // 2), d.PASSAGE):
            last = at + d.PASSAGE >= max(1, len(words) - d.PASSAGE // 2)
            row = np.bincount(words[at:] if last else words[at : at + d.PASSAGE], minlength=d.BINS) * idf
            rows.append(row / np.linalg.norm(row))
    matrix = np.array(rows)
    _, values, turn = np.linalg.svd(matrix, full_matrices=False)
    got = d.fit(spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string").where("text IS NOT NULL").repartition(3), idf, rank=8)
    captured = np.linalg.norm(matrix @ np.linalg.qr(got / idf[:, None])[0]) ** 2
    assert captured >= 0.85 * (values[:8] ** 2).sum()
    assert abs(np.linalg.norm(matrix @ (got[:, 0] / idf)) - 1) < 0.1  # the first direction has unit variance


def test_rows_that_repeat_nulls_and_very_long_texts(spark, case):
    items = case[0]
    long = " ".join(prose(random.Random(6), 150_000)) + " " + items[2][1]
    docs = spark.createDataFrame([(1, items[0][1], 5), (1, items[0][1], 5), (None, items[1][1], 5), (2, long, 5), (3, None, 5)], "doc_id long, text string, item_id int")
    found = [(r.doc_id, r.item_id) for r in d.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, 0), (1, 0), (None, 1), (2, 2)], key=str)
    assert d.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect() == [(3, None, 5)]


def test_empty_tables(spark, case):
    docs, items = frames(spark, case)
    assert d.leaks(docs.where("false"), items).count() == 0
    assert d.leaks(docs, items.where("false")).count() == 0
    assert d.without_leaks(docs, items.where("false")).count() == docs.count()


def test_hashes_tell_words_apart_and_do_not_depend_on_the_neighbours():
    texts = ["Ab c-d É", "", "  x ", "d c AB", "ab" * 3000]
    hashes, sizes = d.hashed(texts)
    assert sizes.tolist() == [4, 0, 1, 3, 1]
    alone = np.concatenate([d.hashed([t])[0] for t in texts])
    assert np.array_equal(hashes, alone)
    assert hashes[0] == hashes[7] and hashes[1] == hashes[6] and len({int(h) for h in hashes}) == 6


def test_common_subsequence_equals_the_table_method():
    rnd = random.Random(5)
    for _ in range(100):
        a, b = ([rnd.randrange(6) + (rnd.randrange(4) << 50) for _ in range(rnd.randint(1, 90))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        item = d.Item(0, np.array(a, dtype=np.uint64), np.ones(d.BINS))
        assert d.common_subsequence(item, b) == table[-1][-1]


def test_long_texts_are_searched_in_blocks(case, monkeypatch):
    items = case[0]
    rnd = random.Random(1)
    projection = np.random.default_rng(0).standard_normal((d.BINS, 48)).astype(np.float32)
    monkeypatch.setattr(d, "BLOCK_WORDS", 500)
    words = prose(rnd, 5000)
    for k in range(10):
        words[400 * k + 300 : 400 * k + 300] = items[k][1].split()
    found = d.Searcher(items, projection, np.ones(d.BINS)).search(["few words", " ".join(words)])
    assert {(k, i) for k, i, *_ in found} >= {(1, i) for i in range(10)}


def test_hashes_and_cosines_of_long_texts():
    """Hashes by a plain restatement; a window's vector is the sum of its own words', not a difference of sums that grow with the text."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcé0", k=n))
    texts = ["", *[" ".join(word(rnd.choice((1, 2, 5, 23, 24, 25, 40, 1100))) for _ in range(12)) for _ in range(5)], "!", "A-b"]
    by_byte, by_place = (list(map(int, f)) for f in d._factors())

    def plain(w: str) -> int:
        h = sum(by_byte[b] * by_place[k % 1024] for k, b in enumerate(w.encode())) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        return h ^ h >> 32

    found, sizes = d.hashed(texts)
    words = [t.lower().replace("!", " ").replace("-", " ").split() for t in texts]
    assert sizes.tolist() == list(map(len, words)) and found.tolist() == [plain(w) for ws in words for w in ws]

    # The other words' vectors are long in one direction.
    item = " ".join(word(6) for _ in range(d.LEAST_WINDOW))
    projection = np.random.default_rng(1).standard_normal((d.BINS, 16)).astype(np.float32)
    projection[np.setdiff1d(np.arange(d.BINS), d.bin_of(d.hashed([item])[0])), 0] += 1000
    text = " ".join([*(word(7) for _ in range(d.BLOCK_WORDS - d.LEAST_WINDOW)), item])
    ((_, _, cosine, share, answer, _),) = d.Searcher([(1, item)], projection, np.ones(d.BINS)).search([text])
    assert share == answer == 1 and abs(cosine - 1) < 1e-5
