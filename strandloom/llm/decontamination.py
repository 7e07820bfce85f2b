"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all documents' words (lower case; runs of ASCII other than letters and
   digits part words), hashed into ``BINS``, give the idf weights.
2. A randomised SVD of the TF-IDF matrix of all passages, of the documents and of the benchmark, gives ``RANK`` latent
   directions: random vectors are multiplied by the matrix and its transpose in a distributed pass over every row, and the
   directions come from that product by the Nystrom formula. (With ``ROUNDS`` above one, passes over an orthogonalised product come before.)
3. Every document is searched whole. Windows of several lengths, each sliding by half its length,
   are projected as sums of their words' vectors; those whose cosine with a benchmark item of about that
   length reaches ``COSINE`` are candidates.
4. A candidate is checked on the words around it, in stretches a quarter longer than the item: the
   longest common subsequence with the item, and how many of the item's answer words (its rarest) occur. It is a leak if the subsequence holds
   ``LCS_ALONE`` of the item, or ``LCS_WITH_ANSWER`` and the region holds ``ANSWER_SHARE`` of the answer
   words; in either case two answer words at least (all, of an item with fewer).

Words are compared by 64-bit hashes, computed for many texts at once. The benchmark is the stated query
set; it is taken in blocks of about ``ITEM_BLOCK`` items and ``BLOCK_CHARS`` characters, one after the other: a block is sent to every
task, searched for and destroyed before the next one. So its size has no bound but that of one item. Nothing else grows with the corpus but the passes.

Edge cases: null or empty texts and items hold and match nothing; items of equal text each match;
rows with equal ids are reported once a row, their best window each; ties of windows go to the
earliest; texts may be of any length, ``BLOCK_WORDS`` words are looked at at a time; an empty table, or an empty benchmark, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut, filter_slices, id_and_text, sum_blocks, table

BIN_BITS = 14
BINS = 1 << BIN_BITS
#: On check_l, 6,863 of 6,863 (document, item) pairs that a search with ``cosine=-2`` (no candidate left out) finds; 6,861 with 40 + 8 and 0.25.
RANK, EXTRA, ROUNDS = 64, 16, 1
SEED = 11
PASSAGE = 48
#: Bins whose sums travel together; passages that are multiplied at once.
CHUNK, FEW = 256, 32
ITEM_BLOCK, BLOCK_CHARS = 20_000, 32 << 20
COSINE = 0.3
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_WORDS, ANSWER_SHARE, LEAST_ANSWER = 0.8, 0.5, 5, 0.8, 2
#: Window lengths grow by this factor from the least; windows begin and end at multiples of the grain.
LADDER, LEAST_WINDOW, GRAIN = 1.5, 8, 4
#: Texts that are hashed at once, words that are projected at once.
TEXTS, BLOCK_WORDS = 64, 60_000
#: Cosines and windows that are computed at once.
COSINES, WINDOWS = 1 << 21, 4096
FLAG_BITS = 20

_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_LONGEST = 1024  # places of a word's bytes that have a factor of their own
_SORTED = 24  # bytes of words that are taken a place at a time


@functools.cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    return rnd.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1), rnd.integers(1, 1 << 63, _LONGEST, dtype=np.uint64) | np.uint64(1)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the texts' words, words of each text)."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]).translate(_TABLE), dtype=np.uint8)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, size = edge[::2], edge[1::2] - edge[::2]
    if not len(begin):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    by_byte, by_place = _factors()
    # The longest words first: those that have a byte at a place are then the first so many.
    order = np.argsort(np.minimum(size, _SORTED).astype(np.uint8), kind="stable")[::-1]
    at, left = begin[order], size[order]
    sums = by_byte[data[at]] * by_place[0]
    more = np.cumsum(np.bincount(np.minimum(size, _SORTED), minlength=_SORTED + 1)[::-1])[::-1]
    for k in range(1, _SORTED):
        n = int(more[k + 1])
        if not n:
            break
        sums[:n] += by_byte[data[at[:n] + k]] * by_place[k]
    if n := int(more[_SORTED]):
        # What very long words have from there on.
        rest = left[:n] - _SORTED
        some = np.flatnonzero(rest)
        low = np.cumsum(rest[some]) - rest[some]
        place = np.arange(rest.sum()) - np.repeat(low, rest[some]) + _SORTED
        if len(some):
            sums[some] += np.add.reduceat(by_byte[data[np.repeat(at[some], rest[some]) + place]] * by_place[place & (_LONGEST - 1)], low)
    h = np.empty_like(sums)
    h[order] = sums
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    starts = np.cumsum([1, *(len(p) + 1 for p in parts[:-1])])
    return h, np.bincount(np.searchsorted(starts, begin, side="right") - 1, minlength=len(texts))


def bin_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int32)


def in_slices(batches, size: int = TEXTS):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bin's words, documents), over all rows."""

    def count(batches):
        total = np.zeros(BINS + 1)
        for part in in_slices(batches):
            hashes, sizes = hashed(part.column(0).to_pylist())
            seen = np.zeros((len(sizes), BINS), dtype=bool)
            seen[np.repeat(np.arange(len(sizes)), sizes), bin_of(hashes)] = True
            total[:BINS] += seen.sum(axis=0, dtype=np.int32)
            total[BINS] += len(sizes)
        if total[BINS]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "block"])

    rows = sum_blocks(docs.select("text").mapInArrow(count, "part int, block binary"), "part", "int").collect()  # one row
    total = np.frombuffer(rows[0].block, dtype="<f8") if rows else np.zeros(BINS + 1)
    return total[:BINS], int(total[BINS])


def cells(every: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, bin, term frequency) of texts' words, by passage, then bin. Passages have ``PASSAGE`` words; a short rest belongs to the last."""
    count = np.maximum(1, -(-(sizes - PASSAGE // 2) // PASSAGE)) * (sizes > 0)
    first, low = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    place = np.arange(len(every)) - np.repeat(first, sizes)
    owner = np.repeat(low, sizes) + np.minimum(place // PASSAGE, np.repeat(count, sizes) - 1)
    cell, tf = np.unique(owner << BIN_BITS | every, return_counts=True)
    return cell >> BIN_BITS, (cell & (BINS - 1)).astype(np.uint16), tf.astype(np.float32)


def fit(texts: DataFrame, idf: np.ndarray, rank: int | None = None) -> np.ndarray:
    """The projection (bins x rank) of a bag of words onto the latent directions of ``texts`` (text), each scaled to unit variance."""
    rank = rank or RANK
    width = min(rank + EXTRA, BINS)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((BINS, width)))[0]
    square = (idf**2).astype(np.float32)

    def product(block: np.ndarray) -> np.ndarray:
        """(matrix transposed) (matrix) (block), distributed over all rows. A passage has length one, so that long and rare ones weigh the same."""
        sent = texts.sparkSession.sparkContext.broadcast((idf[:, None] * block).astype(np.float32))  # of a fixed size

        def run(batches):
            total, seen = np.zeros((BINS, width)), False
            for part in in_slices(batches):
                hashes, sizes = hashed(part.column(0).to_pylist())
                if not len(hashes):
                    continue
                passage, at, tf = cells(bin_of(hashes), sizes)
                n = int(passage[-1]) + 1
                norm = np.maximum(np.bincount(passage, tf * tf * square[at], minlength=n), 1e-9).astype(np.float32)
                # Small dense blocks of the matrix: a few passages by the bins that they have.
                for low, high in itertools.pairwise(range(0, n + FEW, FEW)):
                    some = slice(*np.searchsorted(passage, (low, high)))
                    bins, column = np.unique(at[some], return_inverse=True)
                    matrix = np.zeros((min(high, n) - low, len(bins)), dtype=np.float32)
                    matrix[passage[some] - low, column] = tf[some]
                    total[bins] += matrix.T @ (matrix @ sent.value[bins] / norm[low:high, None])
                seen = True
            if seen:
                for k in range(0, BINS, CHUNK):
                    block = total[k : k + CHUNK].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

        found = sum_blocks(texts.mapInArrow(run, "part int, block binary"), "part", "int").collect()  # BINS / CHUNK rows
        sent.destroy()
        made = np.zeros((BINS, width))
        for r in found:
            made[r.part : r.part + CHUNK] = np.frombuffer(r.block, dtype="<f8").reshape(CHUNK, width)
        return made * idf[:, None]

    made = product(basis)
    for _ in range(ROUNDS - 1):
        basis = np.linalg.qr(made)[0]
        made = product(basis)
    # Nystrom: the matrix is about made (basis' made)^-1 made'; a small shift keeps the inverse stable.
    shift = 1e-6 * max(np.linalg.norm(made), 1e-12)
    shifted = made + shift * basis
    root = np.linalg.cholesky((basis.T @ shifted + shifted.T @ basis) / 2)
    directions, values, _ = np.linalg.svd(np.linalg.solve(root, shifted.T).T, full_matrices=False)
    values = np.maximum(values**2 - shift, 0)
    keep = [k for k in range(min(rank, width)) if values[k] > 1e-6 * max(values[0], 1e-12)]
    return (idf[:, None] * directions[:, keep] / np.sqrt(values[keep])).astype(np.float32)


class Item:
    def __init__(self, item_id: int, words: np.ndarray, idf: np.ndarray):
        self.item_id, self.words = item_id, words
        self.places: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << k
        rarest = sorted(self.places, key=lambda w: (-idf[w >> (64 - BIN_BITS)], w))
        self.answer = frozenset(rarest[:ANSWER_WORDS])
        self.least_answer = min(LEAST_ANSWER, len(self.answer))


def common_subsequence(item: Item, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    n = len(item.words)
    full = row = (1 << n) - 1
    places = item.places
    for w in words:
        if w in places:
            u = row & places[w]
            row = (row + u | row - u) & full
    return n - row.bit_count()


def window_of(n_words: int) -> int:
    length = LEAST_WINDOW
    while length < n_words:
        length = -(-int(length * LADDER) // GRAIN) * GRAIN
    return length


class Searcher:
    def __init__(self, items: list[tuple[int, str]], projection: np.ndarray, idf: np.ndarray, cosine: float = COSINE):
        self.cosine = cosine
        self.projection = np.concatenate([projection, np.zeros((1, projection.shape[1]), dtype=np.float32)])  # the last bin fills up grains
        self.levels: dict[int, tuple[list[Item], np.ndarray]] = {}
        grouped: dict[int, list[Item]] = {}
        self.flag = np.zeros(1 << FLAG_BITS, dtype=np.int32)
        for item_id, text in items:
            words, _ = hashed([text])
            if len(words):
                item = Item(item_id, words, idf)
                grouped.setdefault(window_of(len(words)), []).append(item)
                self.flag[[w & ((1 << FLAG_BITS) - 1) for w in item.answer]] = 1
        for length, group in sorted(grouped.items()):
            vectors = np.stack([projection[bin_of(i.words)].sum(axis=0) for i in group])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            self.levels[length] = (group, np.ascontiguousarray(vectors.T))
        self.reach = max(self.levels, default=0)

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, float, int]]:
        """(number of the text, item, cosine, share of the item in the subsequence, share of answer words, first word)."""
        found: dict[tuple[int, int], tuple] = {}
        if self.levels:
            hashes, sizes = hashed(texts)
            first = np.cumsum(sizes) - sizes
            part: list[tuple[int, int, int]] = []  # text, from, to
            held = 0
            for k, n in enumerate(sizes.tolist()):
                at = 0
                while at < n:
                    stop = min(n, at + BLOCK_WORDS)
                    part.append((k, at, stop))
                    held += stop - at
                    if held >= BLOCK_WORDS:
                        self._block(part, hashes, first, sizes, found)
                        part, held = [], 0
                    at = n if stop == n else stop - 2 * self.reach if 2 * self.reach < BLOCK_WORDS // 2 else stop - BLOCK_WORDS // 2
            if part:
                self._block(part, hashes, first, sizes, found)
        return [(k, item, *rest) for (k, item), rest in sorted(found.items())]

    def _block(self, part, hashes, first, sizes, found) -> None:
        words = np.concatenate([hashes[first[k] + a : first[k] + b] for k, a, b in part])
        size = np.array([b - a for _, a, b in part])
        begin = np.cumsum(size) - size
        # Sums of the vectors of GRAIN words each, none across two texts; the last one is of none.
        grains = -(-size // GRAIN)
        low = np.cumsum(grains) - grains
        bins = np.full(GRAIN * int(grains.sum()), BINS, dtype=np.int32)
        bins[np.repeat(GRAIN * low - begin, size) + np.arange(len(words))] = bin_of(words)
        none = int(grains.sum())
        grain = np.zeros((none + 1, self.projection.shape[1]), dtype=np.float32)
        for k in range(GRAIN):
            grain[:-1] += self.projection[bins[k::GRAIN]]
        flags = np.zeros(len(words) + 1, dtype=np.int32)
        np.cumsum(self.flag[(words & np.uint64((1 << FLAG_BITS) - 1)).astype(np.int32)], out=flags[1:])
        for length, (group, vectors) in self.levels.items():
            long = length // GRAIN
            step = max(1, long // 2)
            # Windows of each piece: one a step, the last one ending with the piece.
            counts = np.maximum(0, -(-(grains - long) // step)) + 1
            owner = np.repeat(np.arange(len(part)), counts)
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = low[owner] + np.minimum(nth * step, np.maximum(grains[owner] - long, 0))
            stop = np.minimum(start + long, low[owner] + grains[owner])
            # The region of a candidate: half a window more to both sides.
            left = np.maximum((start - low[owner]) * GRAIN - length // 2, 0)
            right = np.minimum((stop - low[owner]) * GRAIN + length // 2, size[owner])
            hits = flags[begin[owner] + right] - flags[begin[owner] + left]
            # A leak has answer words, so windows with too few of all items' answer words around them hold none.
            some = np.flatnonzero(hits >= min(i.least_answer for i in group))
            rows = max(1, min(WINDOWS, COSINES // len(group)))
            for b in range(0, len(some), rows):
                chosen = some[b : b + rows]
                at, end = start[chosen], stop[chosen]
                window = grain[at]
                for k in range(1, long):
                    window += grain[np.where(at + k < end, at + k, none)]
                norm = np.sqrt(np.einsum("ij,ij->i", window, window))
                cosines = window @ vectors
                row, col = np.nonzero(cosines >= (self.cosine * norm)[:, None])
                for r, c in zip(row.tolist(), col.tolist(), strict=True):
                    at = chosen[r]
                    k, a, _ = part[owner[at]]
                    self._check(k, group[c], hashes[first[k] : first[k] + sizes[k]], a + int(left[at]), a + int(right[at]), float(cosines[r, c] / max(norm[r], 1e-12)), found)

    def _check(self, k, item, words, begin, end, cosine, found) -> None:
        region = words[begin:end].tolist()
        n = len(item.words)
        if len(item.answer.intersection(region)) < item.least_answer or common_subsequence(item, region) < LCS_WITH_ANSWER * n:
            return
        # The subsequence and the answer words must stand within hardly more words than the item has.
        room = n + n // 4 + 2
        for at in range(0, max(1, len(region) - room + n // 8 + 1), n // 8 + 1):
            near = region[at : at + room]
            share, answer = common_subsequence(item, near) / n, len(item.answer.intersection(near)) / len(item.answer)
            if answer * len(item.answer) >= item.least_answer and (share >= LCS_ALONE or share >= LCS_WITH_ANSWER and answer >= ANSWER_SHARE):
                key = (k, item.item_id)
                if key not in found or (share, cosine, -begin - at) > (found[key][1], found[key][0], -found[key][3]):
                    found[key] = (cosine, share, answer, begin + at)


class Index:
    """What a search needs, and the benchmark's items in blocks: idf and latent directions of all documents and items."""

    def __init__(self, corpus: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, cosine: float):
        items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
        self.spark, self.cosine = corpus.sparkSession, cosine
        n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        self.blocks = max(-(-n // ITEM_BLOCK), -(-chars // BLOCK_CHARS)) if n else 0
        if self.blocks:
            frequency, rows = document_frequencies(corpus)
            self.idf = np.log((rows + 1) / (frequency + 1)) + 0.1
            self.projection = fit(corpus.select("text").unionAll(items.select("text")), self.idf)
            self.items = items if self.blocks == 1 else cut(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(self.blocks))).repartition("block"))

    def states(self):
        """A broadcast search state for each block of items, one at a time; each but the last is destroyed when the next is asked for."""
        for b in range(self.blocks):
            part = self.items if self.blocks == 1 else self.items.where(F.col("block") == b)
            state = self.spark.sparkContext.broadcast(([(r.item_id, r.text) for r in part.collect()], self.projection, self.idf, self.cosine))  # a block of items
            yield state, b == self.blocks - 1
            if b < self.blocks - 1:
                state.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word): a row for each document and item that it holds."""
    corpus = id_and_text(docs, id_col, text_col)
    kind = corpus.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs double, answer double, first_word int"
    made = None
    for state, last in Index(corpus, benchmark, item_col, item_text_col, cosine).states():
        part = corpus.mapInArrow(_searching(state), schema)
        part = part if last else cut(part)
        made = part if made is None else made.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if made is None else made


def without_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns. (What is left after each block of items but the last is cut.)"""
    for state, last in Index(id_and_text(docs, id_col, text_col), benchmark, item_col, item_text_col, cosine).states():
        docs = filter_slices(docs, text_col, _clean, lambda state=state: Searcher(*state.value))
        docs = docs if last else cut(docs)
    return docs


def _clean(searcher: Searcher, texts: list[str]) -> list[bool]:
    held = {k for k, *_ in searcher.search(texts)}
    return [k not in held for k in range(len(texts))]


def _searching(state):
    def run(batches):
        searcher = Searcher(*state.value)
        for rows in in_slices(batches, 4 * TEXTS):
            found = searcher.search(rows.column(1).to_pylist())
            if found:
                number, item, cosine, share, answer, first = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(number)), pa.array(item, pa.int64()), pa.array(cosine), pa.array(share), pa.array(answer), pa.array(first, pa.int32())],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"],
                )

    return run


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
