"""Exact substring deduplication through difference-cover anchors.

A window is ``WINDOW`` (13) consecutive words. A word goes if a window that covers it starts
in a document with a smaller id too; all windows are judged on the input. Windows are equal if their 128-bit hashes
(XXH3) are: two different ones among 10 to the 15 would be taken for equal with a chance under one in a hundred million.

Word positions modulo ``PERIOD`` (7) in ``COVER`` (0, 1, 3) are anchors. The cover is a difference cover:
for any two positions i and j some d < 7 puts both i + d and j + d on the cover. So two equal windows
hold, at the same offset, an anchor each whose next ``ANCHOR`` (13 - 7 + 1 = 7) words lie within the
windows and are equal. Hashing only anchors thus misses no window, at 3/7 of the positions:

1. Documents are dealt into shards by a hash of id and text, so that neither an id with many texts nor the rows without an id are a single shard's. Each shard hashes its anchors and sends each distinct hash
   once to the hash's bucket.
2. A bucket tells each shard which of its hashes other shards have.
3. Each shard extends from the anchors that recur, in it or elsewhere: the windows around them are hashed (128
   bits), and each distinct window around an anchor seen elsewhere is sent once, with its least id,
   to the window's bucket.
4. A bucket tells each shard for which windows some other shard has a smaller id.
5. Each shard removes the words of the windows that a smaller id has, here or elsewhere.

What moves is one row for each shard and bucket that have something in common, holding each hash at most once a
shard: a passage in a third of all documents costs a bucket one entry a shard. Pairs of documents are never
made. The texts are shuffled once; the three steps that read them share the exchange.

Edge cases: a null text has no words; fewer than 13 words are never removed; rows with equal ids (copies of a
row among them) are not smaller than each other, so both keep what no smaller id has; a row without an id is
kept whole and makes nothing else go; texts may be of any length, a shard holds its texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, table

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Text bytes that a shard holds on the average.
SHARD_BYTES = 8 << 20
_UPPER = np.uint64(0xFFFFFFFFFFFF0000)  # the bits of an anchor's hash that travel


class Words:
    """The words of a text, joined by single spaces, and where each begins and ends."""

    def __init__(self, text: str):
        words = text.encode().split()
        self.n = len(words)
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=self.n) + 1) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if self.n else self.ends

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover and their hashes; none if there is no window."""
        if self.n < WINDOW:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        last = self.n - ANCHOR + 1
        at = np.sort(np.concatenate([np.arange(c, last, PERIOD) for c in COVER]))
        joined, digest = self.joined, xxhash.xxh3_64_intdigest
        found = [digest(joined[s:e]) for s, e in zip(self.starts[at].tolist(), self.ends[at + ANCHOR - 1].tolist(), strict=True)]
        return at, np.array(found, dtype=np.uint64) & _UPPER

    def windows(self, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows that start at ``at``, as two words each."""
        joined, digest = self.joined, xxhash.xxh3_128_digest
        found = [digest(joined[s:e]) for s, e in zip(self.starts[at].tolist(), self.ends[at + WINDOW - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2)

    def around(self, at: np.ndarray) -> np.ndarray:
        """For each window, whether it holds one of the anchors ``at``."""
        edge = np.zeros(self.n - WINDOW + 2, dtype=np.int64)
        np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
        np.add.at(edge, np.minimum(at, self.n - WINDOW) + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def without(self, gone: np.ndarray) -> tuple[int, str]:
        """(words removed, the rest joined by spaces) for the windows that ``gone`` marks."""
        edge = np.zeros(self.n + 1, dtype=np.int64)
        edge[: len(gone)] += gone
        edge[WINDOW : len(gone) + WINDOW] -= gone
        keep = np.cumsum(edge[:-1]) == 0
        runs = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
        pieces = [self.joined[self.starts[a] : self.ends[b - 1]] for a, b in runs.reshape(-1, 2).tolist()]
        return int(self.n - keep.sum()), b" ".join(pieces).decode()


def bucket_edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket but the first."""
    return np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def in_order(rows: pa.Table) -> list[tuple[int | None, str]]:
    """A shard's documents in an order of their own, the same in each step."""
    return sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def made(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def packed(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of anchor hashes; a chance agreement of the rest only makes one more window be compared in full."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    whole[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return whole.view(">u8").reshape(-1).astype(np.uint64)


def packed_ids(ids: np.ndarray) -> bytes:
    """The least id, then each id's distance to it, in 4 bytes each where they suffice."""
    low = ids.min()
    away = (ids - low).astype(np.uint64)
    return np.int64(low).tobytes() + (away.astype("<u4") if away.max() < 1 << 32 else away).tobytes()


def unpacked_ids(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data[:8], dtype=np.int64)[0]
    return np.frombuffer(data[8:], dtype="<u4" if len(data) == 8 + 4 * n else np.uint64).astype(np.int64) + low


TO_BUCKET = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])
TO_SHARD = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: Kinds of messages to a shard: anchors of other shards, its own marked windows, windows of smaller ids elsewhere.
SHARED, MARKED, SMALLER = 0, 1, 2


def shard_anchors(buckets: int):
    edges = bucket_edges(buckets)

    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        found = [Words(text).anchors()[1] for doc, text in in_order(rows) if doc is not None]
        hashes = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
        pieces = np.split(hashes, np.searchsorted(hashes, edges))
        return made(TO_BUCKET, [(b, shard, packed(p), None) for b, p in enumerate(pieces) if len(p)])

    return run


def bucket_shares(rows: pa.Table) -> pa.Table:
    """The hashes of two shards or more, to each of their shards."""
    shards = rows["shard"].to_pylist()
    pieces = [unpacked(h) for h in rows["hashes"].to_pylist()]
    values, counts = np.unique(np.concatenate(pieces), return_counts=True)
    common = values[counts > 1]
    told = [(s, p[member(p, common)]) for s, p in zip(shards, pieces, strict=True)]
    return made(TO_SHARD, [(s, SHARED, packed(p)) for s, p in told if len(p)])


def least_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, the least id of each, and for each row the number of its hash)."""
    order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
    sorted_ = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return sorted_[new], ids[order][new], number


def shard_windows(buckets: int):
    edges = bucket_edges(buckets)

    def run(rows: pa.Table, messages: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return made(TO_BUCKET, [])
        shard = rows["shard"][0].as_py()
        parts = [unpacked(h) for h in messages["hashes"].to_pylist()]
        elsewhere = np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)
        docs = [(doc, Words(text)) for doc, text in in_order(rows)]
        anchors = [words.anchors() if doc is not None else None for doc, words in docs]
        own = [np.unique(a[1]) for a in anchors if a is not None]
        values, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, dtype=np.uint64),) * 2
        here = values[counts > 1]
        marks, sent, ids = [], [], []
        for (doc, words), found in zip(docs, anchors, strict=True):
            if words.n < WINDOW:
                continue
            if found is None:
                marks.append(np.zeros(words.n - WINDOW + 1, dtype=bool))
                continue
            at, hashes = found
            far = words.around(at[member(hashes, elsewhere)])
            marks.append(far | words.around(at[member(hashes, here)]))
            start = np.flatnonzero(far)
            if len(start):
                sent.append(words.windows(start))
                ids.append(np.full(len(start), doc, dtype=np.int64))
        made_rows = []
        if any(m.any() for m in marks):
            # The marks pass the buckets under a number of their own, one for each shard.
            made_rows.append((buckets + shard, shard, np.packbits(np.concatenate(marks)).tobytes(), None))
        if sent:
            hashes, least, _ = least_ids(np.concatenate(sent), np.concatenate(ids))
            cuts = np.searchsorted(hashes[:, 0], edges)
            for b, (h, i) in enumerate(zip(np.split(hashes, cuts), np.split(least, cuts), strict=True)):
                if len(h):
                    made_rows.append((b, shard, h.tobytes(), packed_ids(i)))
        return made(TO_BUCKET, made_rows)

    return run


def bucket_least(rows: pa.Table) -> pa.Table:
    """To each shard, its windows of which another shard has a smaller id; marks are passed on."""
    shards, hashes, ids = (rows[c].to_pylist() for c in ("shard", "hashes", "ids"))
    if ids[0] is None:
        return made(TO_SHARD, [(s, MARKED, h) for s, h in zip(shards, hashes, strict=True)])
    pieces = [np.frombuffer(h, dtype="<u8").reshape(-1, 2) for h in hashes]
    own = np.concatenate([unpacked_ids(i, len(p)) for i, p in zip(ids, pieces, strict=True)])
    _, least, number = least_ids(np.concatenate(pieces), own)
    smaller = np.split(least[number] < own, np.cumsum([len(p) for p in pieces])[:-1])
    return made(TO_SHARD, [(s, SMALLER, p[m].tobytes()) for s, p, m in zip(shards, pieces, smaller, strict=True) if m.any()])


def shard_result(rows: pa.Table, messages: pa.Table) -> pa.Table:
    marks, smaller = None, []
    for kind, data in zip(messages["kind"].to_pylist(), messages["hashes"].to_pylist(), strict=True):
        if kind == MARKED:
            marks = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).astype(bool)
        else:
            smaller.append(np.frombuffer(data, dtype="<u8").reshape(-1, 2))
    docs = [(doc, Words(text)) for doc, text in in_order(rows)]
    starts, hashes, ids, at = [], [], [], 0
    for doc, words in docs:
        n = max(0, words.n - WINDOW + 1)
        start = np.flatnonzero(marks[at : at + n]) if marks is not None else np.empty(0, dtype=np.int64)
        at += n
        starts.append(start)
        if len(start):
            hashes.append(words.windows(start))
            ids.append(np.full(len(start), doc, dtype=np.int64))
    gone = np.empty(0, dtype=bool)
    if hashes:
        # The windows of smaller ids elsewhere join in under an id below all others.
        below = np.iinfo(np.int64).min
        foreign = np.concatenate(smaller) if smaller else np.empty((0, 2), dtype=np.uint64)
        own = np.concatenate(ids)
        _, least, number = least_ids(np.concatenate([*hashes, foreign]), np.concatenate((own, np.full(len(foreign), below))))
        gone = least[number[: len(own)]] < own
    out, at = [], 0
    for (doc, words), start in zip(docs, starts, strict=True):
        mine = np.zeros(max(0, words.n - WINDOW + 1), dtype=np.int64)
        mine[start] = gone[at : at + len(start)]
        at += len(start)
        removed, kept = words.without(mine) if len(start) else (0, words.joined.decode())
        out.append((doc, words.n, removed, kept))
    return made(RESULT, out)


def dedup(df: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept holds the words that stay, joined by single spaces."""
    docs = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).groupBy("shard")
    to_bucket, to_shard = "bucket int, shard int, hashes binary, ids binary", "shard int, kind int, hashes binary"
    shared = dealt.applyInArrow(shard_anchors(shards), to_bucket).groupBy("bucket").applyInArrow(bucket_shares, to_shard)
    least = dealt.cogroup(shared.groupBy("shard")).applyInArrow(shard_windows(shards), to_bucket).groupBy("bucket").applyInArrow(bucket_least, to_shard)
    return dealt.cogroup(least.groupBy("shard")).applyInArrow(shard_result, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS win FROM s
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS gone FROM w
), k AS (
  SELECT doc_id, words[p] AS word, p FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)
), c AS (
  SELECT k.doc_id, k.word, k.p,
    coalesce(bool_or(m.gone) OVER (PARTITION BY k.doc_id ORDER BY k.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS removed
  FROM k LEFT JOIN m ON m.doc_id = k.doc_id AND m.i = k.p
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
