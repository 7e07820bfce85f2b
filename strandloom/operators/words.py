"""Repeated words of fragments, substring search, and comparisons of word sets.

No suffix index is built: words are tables of k-mers, counted with map-side combination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S

MAX_LENGTH = 100
#: Lengths whose words are counted; longer ones are found by sorting.
LENGTHS_COUNTED = 8
#: Bytes of a word that a place is tried with before longer ones; a table's bits, as a power of two (32 MB), at most; bytes that are looked at at once.
PREFIX, MOST_BITS, BLOCK = 18, 28, 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def occurrences(seqs: DataFrame, k: int) -> DataFrame:
    """(frag_id, pos, word): every word of length k with its place, from 0."""
    return seqs.select("frag_id", F.posexplode(S.kmers("seq", k)).alias("pos", "word"))


def counted(seqs: DataFrame, k: int) -> DataFrame:
    return seqs.select(F.explode(S.kmers("seq", k)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def branching(seqs: DataFrame, lengths: range) -> DataFrame:
    """(word, cnt): words of these lengths that occur twice or more and are followed by two different things or more.

    A fragment's end follows its last word; the end of the fragment with the greatest id differs from all other ends."""
    return _branching(_ended(seqs).select(F.explode(F.flatten(F.array(*[S.kmers("seq", k + 1) for k in lengths]))).alias("w")))


def _ended(seqs: DataFrame) -> DataFrame:
    """(frag_id, seq) with a symbol for the fragment's end."""
    last = seqs.agg(F.max("frag_id").alias("last_id"))  # one row
    return seqs.crossJoin(F.broadcast(last)).select("frag_id", F.concat("seq", F.when(F.col("frag_id") == F.col("last_id"), "Z").otherwise("E")).alias("seq"))


def _branching(found: DataFrame) -> DataFrame:
    """(word, cnt) of words ``w`` that have what follows them as their last symbol."""
    rows = found.select(F.expr("substr(w, 1, length(w) - 1)").alias("word"), F.right("w", F.lit(1)).alias("after"))
    bits = F.expr("case after when 'A' then 1 when 'T' then 2 when 'G' then 4 when 'C' then 8 when 'E' then 16 else 32 end")
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.bit_or(bits).alias("after"))
    return counts.where((F.col("cnt") >= 2) & (F.bit_count("after") >= 2)).select("word", "cnt")


def superseded(groups: DataFrame, least: int) -> DataFrame:
    """Without the words that a shorter one with a larger count, next in order and a prefix of it, replaces."""
    key = F.concat(S.codes("word"), F.lit("~"))
    order = Window.partitionBy(F.substring("word", 1, least)).orderBy(key)
    after, count = F.lead("word").over(order), F.lead("cnt").over(order)
    marked = groups.withColumn("gone", F.coalesce((F.length(after) < F.length("word")) & F.startswith(F.col("word"), after) & (count > F.col("cnt")), F.lit(False)))
    return marked.where(~F.col("gone")).drop("gone")


def element_groups(seqs: DataFrame, least: int = 10, most: int = MAX_LENGTH) -> DataFrame:
    """(word, cnt): right-branching repeated words of ``least`` to ``most`` symbols that are not of low complexity.

    The first lengths are counted. A longer word begins at a place whose next ``LENGTHS_COUNTED`` more symbols repeat; from those places the symbols up to the
    greatest length are sorted, and the words are where neighbours part (``_parting``)."""
    lengths = range(least, min(least + LENGTHS_COUNTED, most + 1))
    found = branching(seqs, lengths)
    if lengths[-1] < most:
        low = lengths[-1] + 1
        found = found.unionByName(_parting(_repeating(_ended(seqs), low, most + 1), low, most))
    return superseded(found.where(S.is_complex("word")), least)


def _repeating(seqs: DataFrame, k: int, most: int) -> DataFrame:
    """(tail, n): the ``most`` symbols from each place whose word of length k occurs twice or more, and how often they are there."""
    places = seqs.select("frag_id", F.posexplode(S.kmers("seq", k)).alias("pos", "word")).where(~F.right("word", F.lit(1)).isin("E", "Z"))
    again = places.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word")
    kept = places.join(again, "word", "left_semi").groupBy("frag_id").agg(F.collect_list("pos").alias("places"))  # of one fragment
    tails = seqs.join(kept, "frag_id").select(F.explode(F.transform("places", lambda at: F.substr(F.col("seq"), at + 1, F.lit(most)))).alias("tail"))
    return tails.groupBy("tail").agg(F.count(F.lit(1)).alias("n"))


def _parting(tails: DataFrame, low: int, most: int) -> DataFrame:
    """(word, cnt): words of ``low`` to ``most`` symbols after which tails (tail, n; all different) go on in two ways or more.

    Tails that begin alike meet in one task, in order, and stream through it: what it holds is a stack of the words that are still open, each a prefix of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_words: list[list[int]] = []  # length, count so far
        last, last_n = "", 0

        def close(length: int, out: list[tuple[str, int]]) -> int:
            """Closes words longer than this; how often the last of them, or the last tail, occurs."""
            count = last_n
            while open_words and open_words[-1][0] > length:
                size, before = open_words.pop()
                count += before
                if low <= size <= most:
                    out.append((last[:size], count))
            return count

        for batch in batches:
            tail, n, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            width = most + 2  # a tail's end differs from any symbol
            rows = np.frombuffer("".join(t.ljust(width) for t in [last, *tail]).encode(), dtype=np.uint8).reshape(-1, width)
            common = (rows[1:] != rows[:-1]).argmax(axis=1).tolist()
            for t, k, length in zip(tail, n, common, strict=True):
                if last:
                    count = close(length, out)
                    if open_words and open_words[-1][0] == length:
                        open_words[-1][1] += count
                    else:
                        open_words.append([length, count])
                last, last_n = t, k
            yield _rows(out)
        out = []
        close(-1, out)
        yield _rows(out)

    begins = F.substring("tail", 1, low).alias("begins")
    dealt = tails.select("tail", "n", begins).repartition("begins").sortWithinPartitions("tail").select("tail", "n")
    return dealt.mapInArrow(run, "word string, cnt long")


def _rows(found: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "cnt"])


class _Stretches:
    """Hashes of stretches of bytes, of any place and size, from sums over all bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        factors = np.full((2, len(data)), 1, dtype=np.uint64)
        factors[0, 1:], factors[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        power, self.inverse = np.cumprod(factors, axis=1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * power, out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.inverse[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a table of 2 ** ``bits`` that stand for a hash."""
    drop = np.uint64(64 - bits)
    return hashes >> drop, hashes * np.uint64(0x94D049BB133111EB) >> drop


def _bit_table(groups: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """(64 bits each, number of bits as a power of two, lengths in bytes): a table of bits in which each word's are set, and those of the first ``PREFIX`` bytes of a longer
    one. Its size has a bound; a full table lets more through, which the join that follows finds out."""
    sizes = groups.groupBy(F.octet_length("word").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are lengths
    bits = min(max(16, (32 * sum(r.n for r in sizes)).bit_length()), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in words], dtype=np.int64)
            at, own = np.cumsum(size) - size, _Stretches(np.frombuffer(b"".join(words), dtype=np.uint8))
            slots = np.unique(np.concatenate([s for n in (size, np.minimum(size, PREFIX)) for s in _slots(own.hashes(at, n), bits)]))
            cell, first = np.unique(slots >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first) if len(first) else slots
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    cells = groups.select("word").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.bit_or("value").alias("value"))
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    found = cells.toArrow()  # 2 ** (MOST_BITS - 6) rows at most
    table[found.column("cell").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return table, bits, sorted(r.k for r in sizes)


def _blocks(texts: Iterator[bytes], most: int, overlap: int) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes; longer texts in pieces that overlap."""
    held, size = [], 0
    for text in texts:
        for at in range(0, max(1, len(text) - overlap), most):
            held.append(text[at : at + most + overlap])
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _present(groups: DataFrame, others: DataFrame) -> DataFrame:
    """(found): bytes of the words of ``groups`` that are in the other fragments, and of a few stretches of the same lengths that only share their bits with some.

    Every stretch of a group's length is looked up in a table of bits where it stands; only those that might be a group's leave the block, once each."""
    table, bits, lengths = _bit_table(groups)
    sent = groups.sparkSession.sparkContext.broadcast(table)  # of a bounded size
    short, long, most = [k for k in lengths if k <= PREFIX], [k for k in lengths if k > PREFIX], BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(hashes: np.ndarray) -> np.ndarray:
            one, two = ((sent.value[s >> np.uint64(6)] >> (s & np.uint64(63))).astype(np.uint8) & 1 for s in _slots(hashes, bits))
            return np.flatnonzero(one & two)

        texts = (t.encode() for batch in batches for t in batch.column(0).to_pylist() if t)
        for block in _blocks(texts, most, max(lengths, default=1) - 1):
            data = b"".join(block)
            size = np.array([len(t) for t in block])
            own = _Stretches(np.frombuffer(data, dtype=np.uint8))
            every = np.arange(len(data))
            room = np.repeat(np.cumsum(size), size) - every
            eight = np.ndarray(len(data), np.uint64, data + bytes(8), strides=(1,))  # the eight bytes from each place
            found: list[bytes] = []

            def look(at: np.ndarray, k: int, own=own, room=room, data=data, eight=eight, found=found) -> None:
                at = at[room[at] >= k]
                hashes = own.hashes(at, k)
                some = marked(hashes)
                at = at[some]
                _, first, which = np.unique(hashes[some], return_index=True, return_inverse=True)
                alike = at[first][which]
                # Stretches that share their hash with another one and differ from it are sent, too.
                differ = np.zeros(len(at), dtype=bool)
                for j in [*range(0, k - 7, 8), k - 8] if k >= 8 else []:
                    differ |= eight[at + j] != eight[alike + j]
                for j in range(k) if k < 8 else []:
                    differ |= own.data[at + j] != own.data[alike + j]
                differ[first] = True
                found.extend(data[a : a + k] for a in at[differ].tolist())

            for k in short:
                look(every, k)
            if long:
                at = every[room >= long[0]]
                at = at[marked(own.hashes(at, PREFIX))]
                for k in long:
                    look(at, k)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["found"])

    return others.select("seq").mapInArrow(run, "found binary")


def group_places(seqs: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, cnt, frag_id, pos): every place of the words of ``groups`` (word, cnt), which may be of several lengths."""
    lengths = sorted(r.k for r in groups.select(F.length("word").alias("k")).distinct().collect())  # as many as there are lengths
    words = F.flatten(F.array(*[F.transform(S.kmers("seq", k), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))) for k in lengths or [1]]))
    return seqs.select("frag_id", F.inline(words)).join(groups, "word").select("word", "cnt", "frag_id", "pos")


def cites(seqs: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """(word, frag_id, pos): every place of the words, all of one length."""
    return occurrences(seqs, length).join(words.select("word").distinct(), "word")


def in_match_order(found: DataFrame) -> DataFrame:
    """Matches (frag_id, text_pos, pattern_pos, length) by place, the longer first, then by the place in the pattern."""
    return found.orderBy("frag_id", "text_pos", F.col("length").desc(), "pattern_pos")


def partial_cites(seqs: DataFrame, patterns: DataFrame, least: int) -> DataFrame:
    """(pattern, frag_id, text_pos, pattern_pos, length): the longest match from each pair of places, if ``least`` or longer."""
    seeds = patterns.select(F.col("word").alias("pattern"), F.posexplode(S.kmers("word", least)).alias("pattern_pos", "seed"))
    places = seqs.select("frag_id", "seq", F.posexplode(S.kmers("seq", least)).alias("text_pos", "seed"))
    joined = places.join(seeds, "seed")
    room = F.least(F.length("pattern") - F.col("pattern_pos"), F.length("seq") - F.col("text_pos"))
    longer = F.filter(F.sequence(F.lit(least), room), lambda n: F.substr(F.col("pattern"), F.col("pattern_pos") + 1, n) == F.substr(F.col("seq"), F.col("text_pos") + 1, n))
    return joined.select("pattern", "frag_id", F.col("text_pos").cast("bigint").alias("text_pos"), F.col("pattern_pos").cast("bigint").alias("pattern_pos"), F.array_max(longer).cast("bigint").alias("length"))


def drop_cross(groups: DataFrame, others: DataFrame) -> DataFrame:
    """Groups (word, cnt) whose word is nowhere in the other fragments. The groups are computed once and kept on disk."""
    groups = groups.persist(StorageLevel.DISK_ONLY)
    return groups.join(_present(groups, others).distinct(), F.col("word").cast("binary") == F.col("found"), "left_anti")


def cross_test(groups: DataFrame, others: DataFrame, length: int) -> DataFrame:
    """(word, cnt, other_cnt): each word's occurrences in the other fragments too."""
    found = counted(others, length).withColumnRenamed("cnt", "other_cnt")
    return groups.join(found, "word", "left").select("word", "cnt", F.coalesce("other_cnt", F.lit(0)).cast("bigint").alias("other_cnt"))


def trans_factor(tested: DataFrame, own_size: int, other_size: int) -> DataFrame:
    """(own, factor) of a cross test (word, cnt, other_cnt): all own occurrences, and the other ones if that text were as long as the own, with three digits."""
    own, other = F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint"), F.coalesce(F.sum("other_cnt"), F.lit(0))
    return tested.agg(own.alias("own"), F.bround(F.lit(float(own_size)) * other / F.lit(float(other_size)), 3).alias("factor"))


def text_size(seqs: DataFrame) -> DataFrame:
    """(fragments, text_size, inner_ends): fragments, symbols with one end each, and ends but the last."""
    return seqs.agg(F.count(F.lit(1)).alias("fragments"), (F.sum(F.length("seq")) + F.count(F.lit(1))).alias("text_size"), (F.count(F.lit(1)) - 1).alias("inner_ends"))
