"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit where over half of its shingles' hashes have it. The hash is XXH64
(seed 42) of the shingle; further 64-bit words, for wider fingerprints, are mixed from it.

Distinct fingerprints are sorted and cut into tiles; a pair of tiles is compared completely, by
exclusive or and bit counts in numpy, unless it cannot hold a link. It cannot where the population counts
of the fingerprints' parts differ by more than the radius: a bit that differs moves a part's
count by one at most, so the sum of the parts' differences never exceeds the distance. The same holds
for blocks of rows within a pair of tiles. With ``least_ratio`` (a similarity) tiles are sorted by the
number of shingles, and a pair whose numbers lie further apart than any pair of sets of that similarity
is skipped too. No link is lost by either.

Tiles are numbered in their order and taken in blocks; a unit of work is a pair of blocks and gets each of its tiles
once, however many pairs of them it compares. The blocks grow with the root of the number of pairs, so that the bytes sent
grow as the number of tiles does (until ``MOST_BLOCK`` tiles make a block).

Of a unit only a spanning forest of its links leaves the task: as many rows as
fingerprints at most, however many pairs of a large group are linked, with the same components.

Edge cases: a null or empty text has no word and the fingerprint zero, linked like any other; texts
with fewer words than a shingle are one shingle; equal fingerprints are one node, so repeated rows and copies
cost nothing; an id may come with several texts, each a node of its own; a row without an id links like any other, and its
component is null if no row there has an id; an empty table gives an empty result; other columns are ignored; texts may
be of any length, a task holds one text's hashes at a time.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import attached, cut, id_and_text, map_slices, table
from strandloom.llm.components import components, contracted

SEED = 42
TILE_BYTES = 128 << 10
#: Rows compared at once within a pair of tiles: by population counts, by sizes.
LEAF, BLOCK = 128, 512
#: Links held in a task before they are contracted to a forest.
HELD_LINKS = 1 << 20
#: Fingerprints that a partition holds on the average.
NODES = 100_000
#: Tiles that a block of them holds at most; units of work that a core gets on the average; shingles in the texts of a tile.
MOST_BLOCK, UNITS_A_CORE, TILE_SHINGLES = 32, 4, 1 << 21
#: Rows that a file of a cut holds at least, as long as there is one a core.
FILE_ROWS = 10_000
#: Tiles that a partition may hold.
TILE_BITS = 20
_LANES = np.uint64(0x0101010101010101)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but the space and the characters 9 to 13, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, joined by spaces; of all words if they are fewer."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes, and words mixed from them, as columns."""
    columns = [hashes]
    for k in range(1, words):
        z = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        columns.append(z ^ (z >> np.uint64(31)))
    return np.stack(columns, axis=1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column, the word whose bits are set in over half of the rows."""
    n, words = hashes.shape
    if n == 0:
        return np.zeros(words, dtype=np.uint64)
    counts = np.empty((words, 8, 8), dtype=np.int64)  # word, byte, bit
    at = np.arange(0, n, 255)  # a byte lane holds up to 255
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at, axis=0)
        counts[:, :, bit] = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(at), words, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=2, bitorder="little").reshape(words, 8).copy().view(np.uint64).reshape(words)


def files_of(df: DataFrame, rows: int) -> int:
    """Files of a cut with something for each of ``rows`` rows: one a core at most, or one for ``NODES`` rows."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)), -(-rows // NODES))


def cut_texts(df: DataFrame) -> DataFrame:
    """A cut with a row for each text, before it is known how many there are."""
    return cut(df, UNITS_A_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism))


def fingerprint(text: str, shingle: int, words: int = 1, distinct: bool = False) -> tuple[np.ndarray, int]:
    """(words of the fingerprint, number of shingles); ``distinct`` counts equal shingles once."""
    hashes = shingle_hashes(words_of(text), shingle)
    if distinct:
        hashes = np.unique(hashes)
    return majority(mixed(hashes, words)), len(hashes)


def fingerprints(df: DataFrame, shingle: int = 4, words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, size): the fingerprint's words, big-endian, and the number of shingles."""

    def work(_, cols):
        found = [fingerprint(t, shingle, words, distinct) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "fp": pa.array([f.astype(">u8").tobytes() for f, _ in found], pa.binary()), "size": [n for _, n in found]}

    source = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_slices(source, work, "doc_id bigint, fp binary, size int")


def parts(fp: np.ndarray) -> np.ndarray:
    """Population counts that bound a distance: of 16-bit parts, then of bytes, for one word; of words for several."""
    if fp.shape[1] > 1:
        return np.bitwise_count(fp).astype(np.int16)
    return np.concatenate([np.bitwise_count(fp.view(np.uint16)), np.bitwise_count(fp.view(np.uint8))], axis=1).astype(np.int16)


def groups(words: int) -> list[slice]:
    """The columns of ``parts`` that make up the whole fingerprint each."""
    return [slice(0, words)] if words > 1 else [slice(0, 4), slice(4, 12)]


def leaves(part: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the rows, where its blocks begin): blocks of at most about ``leaf`` rows with close counts.

    The rows are halved again and again along the part whose counts spread widest, at a change of its count: the first four
    parts (16 bits each) as long as they spread, then the others (bytes), which tell rows apart in narrow tiles of large inputs."""
    blocks, todo = [], [np.arange(len(part))]
    while todo:
        rows = todo.pop()
        spread = part[rows].max(axis=0) - part[rows].min(axis=0)
        wide = int(np.argmax(spread[:4])) if spread[:4].any() else int(np.argmax(spread))
        if len(rows) <= leaf or spread[wide] == 0:
            blocks += [rows[at : at + 4 * leaf] for at in range(0, len(rows), 4 * leaf)]
            continue
        count = part[rows, wide]
        order = np.argsort(count, kind="stable")
        middle = count[order[len(rows) // 2]]
        low, high = np.searchsorted(count[order], [middle, middle + 1])
        at = low if low and len(rows) // 2 - low <= high - len(rows) // 2 or high == len(rows) else high
        todo += [rows[order[at:]], rows[order[:at]]]
    return np.concatenate(blocks), np.cumsum([0, *map(len, blocks[:-1])])


def apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least possible sum of differences between points of boxes a and boxes b, for all pairs."""
    gap = np.maximum(low_a[:, None, :] - high_b[None, :, :], low_b[None, :, :] - high_a[:, None, :])
    return np.maximum(gap, 0).sum(axis=2)


def boxes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest values of the blocks that begin at ``at``."""
    return np.minimum.reduceat(values, at, axis=0), np.maximum.reduceat(values, at, axis=0)


def close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a word or more) that differ in ``radius`` bits at most. For small radii the halves of the one word are compared first."""
    if left.shape[1] > 1 or radius > 8:
        return np.nonzero(sum(np.bitwise_count(left[:, None, k] ^ right[None, :, k]) for k in range(left.shape[1])) <= radius)
    left, right = left[:, 0], right[:, 0]
    half = np.bitwise_count(left.astype(np.uint32)[:, None] ^ right.astype(np.uint32)[None, :]) <= radius
    u, v = np.divmod(np.flatnonzero(half), len(right))
    keep = np.bitwise_count(left[u] ^ right[v]) <= radius
    return u[keep], v[keep]


class Radius(NamedTuple):
    """The greatest distance of a link, and that of the first words, between texts the smaller of which has fewer than ``below`` shingles."""

    below: float
    whole: int
    first: int


class Tile(NamedTuple):
    """Rows of fingerprints, in blocks that begin at ``begins``. ``bands``, ``lows`` and ``highs`` bound the rows' bands and parts."""

    number: int
    bands: tuple[int, int]
    sizes: tuple[int, int]
    lows: np.ndarray
    highs: np.ndarray
    fp: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    begins: np.ndarray


def near_rows(a: Tile, b: Tile, same: bool, radii: tuple[Radius, ...], least_ratio: float, first_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links between rows of a and rows of b (of one tile each once), a pair of blocks at a time."""
    (low_a, high_a), (low_b, high_b) = boxes(parts(a.fp), a.begins), boxes(parts(b.fp), b.begins)
    apart_by = [apart(low_a[:, g], high_a[:, g], low_b[:, g], high_b[:, g]) for g in groups(a.fp.shape[1])]
    near = np.logical_and.reduce([x <= max(r.whole for r in radii) for x in apart_by])
    (least_a, most_a), (least_b, most_b) = boxes(a.size, a.begins), boxes(b.size, b.begins)
    near &= (most_a[:, None] >= least_ratio * least_b[None, :]) & (most_b[None, :] >= least_ratio * least_a[:, None])
    if same:
        near = np.triu(near)
    end_a, end_b = np.append(a.begins[1:], len(a.fp)), np.append(b.begins[1:], len(b.fp))
    for i, j in np.argwhere(near).tolist():
        radius = next(r for r in radii if min(least_a[i], least_b[j]) < r.below)
        u, v = close(a.fp[a.begins[i] : end_a[i], :first_words], b.fp[b.begins[j] : end_b[j], :first_words], radius.first)
        u, v = u + a.begins[i], v + b.begins[j]
        if same:
            keep = u < v
            u, v = u[keep], v[keep]
        if a.fp.shape[1] > first_words and len(u):
            keep = np.bitwise_count(a.fp[u] ^ b.fp[v]).sum(axis=1, dtype=np.int64) <= radius.whole
            u, v = u[keep], v[keep]
        if least_ratio and len(u):
            x, y = a.size[u], b.size[v]
            keep = np.minimum(x, y) >= least_ratio * np.maximum(x, y)
            u, v = u[keep], v[keep]
        if len(u):
            yield u, v


def forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links among nodes 0 to n - 1, as stars: (node, root). ``HELD_LINKS`` of them are held at once, or a block pair's."""
    held_u, held_v, held = [], [], 0
    for u, v in found:
        held_u.append(u)
        held_v.append(v)
        held += len(u)
        if held >= HELD_LINKS:
            label = contracted(n, np.concatenate(held_u), np.concatenate(held_v))
            moved = np.flatnonzero(label != np.arange(n))
            held_u, held_v, held = [moved], [label[moved]], 0
    if not held_u:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    label = contracted(n, np.concatenate(held_u), np.concatenate(held_v))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


_TILE = "tile long, band_low int, band_high int, size_low int, size_high int, lows array<int>, highs array<int>, fps binary, sizes binary, ids binary, begins binary"
_ABOUT = [c.split()[0] for c in _TILE.split(", ")][:7]


def tiled(nodes: DataFrame, count: int, words: int, least_ratio: float, tile_rows: int) -> DataFrame:
    """The rows of ``nodes`` (node, fp, size) in tiles that are numbered in the order of the rows: one with close counts (or sizes) next to another."""
    if least_ratio:
        # Bands of sizes: rows whose sizes are within the ratio are at most one band apart.
        band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / -math.log(least_ratio)).cast("int")
        order = [F.col("band"), F.col("size"), F.col("fp"), F.col("node")]
    else:
        word = lambda k: F.bit_count(F.conv(F.hex(F.substring("fp", k, 2)), 16, 10).cast("int")).cast("int")
        band = word(1)
        order = [F.col("band"), *(word(k) for k in (3, 5, 7)), F.col("fp")]
    spread = nodes.withColumn("band", band).repartitionByRange(max(1, -(-count // tile_rows)), *order).sortWithinPartitions(*order)

    def made(number: int, rows: pa.Table) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(rows["fp"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)
        part = parts(values)
        sizes, bands, ids = (rows[c].to_numpy() for c in ("size", "band", "node"))
        coarse = part[:, groups(words)[0]]
        lows, highs = coarse.min(axis=0).tolist(), coarse.max(axis=0).tolist()
        order, begins = (np.arange(len(ids)), np.arange(0, len(ids), BLOCK)) if least_ratio else leaves(part, LEAF)
        blobs = [values[order], sizes[order].astype(np.int32), ids[order].astype(np.int64), begins.astype(np.int32)]
        row = [number, int(bands.min()), int(bands.max()), int(sizes.min()), int(sizes.max()), lows, highs, *(x.tobytes() for x in blobs)]
        kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 2, *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _TILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << TILE_BITS
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held is not None and held.num_rows:
                # A tile ends with its last row or where the texts of its rows hold too many shingles.
                shingles = np.cumsum(held["size"].to_numpy()[:tile_rows].astype(np.int64))
                stop = max(1, min(tile_rows, int(np.searchsorted(shingles, TILE_SHINGLES, side="right")) if least_ratio else tile_rows))
                if stop >= held.num_rows and batch is not None:
                    break
                yield made(number, held.slice(0, stop).combine_chunks())
                held, number = held.slice(stop), number + 1

    return cut(spread.select("node", "fp", "size", "band").mapInArrow(run, _TILE), files_of(nodes, count))


def _meet(a: Tile, b: Tile, radius: int, least_ratio: float, reach: int) -> bool:
    bands = a.bands[0] - reach <= b.bands[1] and b.bands[0] <= a.bands[1] + reach
    sizes = a.sizes[1] >= least_ratio * b.sizes[0] and b.sizes[1] >= least_ratio * a.sizes[0]
    return bands and sizes and int(np.maximum(np.maximum(a.lows - b.highs, b.lows - a.highs), 0).sum()) <= radius


def compared(
    nodes: DataFrame, count: int, words: int, radii: tuple[Radius, ...], least_ratio: float, tile_rows: int | None, result: Callable[[Iterator[tuple[Tile, Tile]]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``result`` of every unit's pairs of tiles that may hold a link; each pair of tiles belongs to one unit."""
    radius = max(r.whole for r in radii)
    reach = 1 if least_ratio else radius
    tiles = tiled(nodes, count, words, least_ratio, tile_rows or TILE_BYTES // (8 * words))
    about = tiles.select(*_ABOUT)
    at = lambda low, high: F.explode(F.sequence(low, high))
    one = about.select(*[F.col(c).alias(f"a_{c}") for c in about.columns], at(F.col("band_low") - reach, F.col("band_high") + reach).alias("band"))
    two = about.select(*[F.col(c).alias(f"b_{c}") for c in about.columns], at(F.col("band_low"), F.col("band_high")).alias("band"))
    gap = F.aggregate(
        F.arrays_zip("a_lows", "a_highs", "b_lows", "b_highs"), F.lit(0), lambda s, x: s + F.greatest(x["a_lows"] - x["b_highs"], x["b_lows"] - x["a_highs"], F.lit(0))
    )
    sizes = (F.col("a_size_high") >= least_ratio * F.col("b_size_low")) & (F.col("b_size_high") >= least_ratio * F.col("a_size_low"))
    pairs = cut(one.join(two, "band").where((F.col("a_tile") <= F.col("b_tile")) & sizes & (gap <= radius)).select("a_tile", "b_tile").distinct(), files_of(nodes, count))
    cores = max(1, nodes.sparkSession.sparkContext.defaultParallelism)
    n_pairs = pairs.count()
    block = max(1, min(MOST_BLOCK, math.isqrt(n_pairs // (UNITS_A_CORE * cores))))
    block_of = lambda c: F.floor(F.shiftright(c, TILE_BITS) / block).cast("int")
    units = pairs.select(block_of("a_tile").alias("ua"), block_of("b_tile").alias("ub"), "a_tile", "b_tile")
    needed = units.select("ua", "ub", F.explode(F.array("a_tile", "b_tile")).alias("tile")).distinct()
    parts_of_work = max(1, min(-(-n_pairs // block**2), 64 * UNITS_A_CORE * cores))
    work = needed.join(tiles, "tile").repartition(parts_of_work, "ua", "ub").sortWithinPartitions("ua", "ub", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(held: dict[int, list[Tile]]) -> Iterator[tuple[Tile, Tile]]:
            for a in held[min(held)]:
                for b in held[max(held)]:
                    if a.number <= b.number and _meet(a, b, radius, least_ratio, reach):
                        yield a, b

        unit, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if unit != (row["ua"], row["ub"]):
                    if held:
                        yield from result(pairs_of(held))
                    unit, held = (row["ua"], row["ub"]), {}
                tile = Tile(
                    row["tile"], (row["band_low"], row["band_high"]), (row["size_low"], row["size_high"]), np.array(row["lows"]), np.array(row["highs"]),
                    np.frombuffer(row["fps"], dtype=np.uint64).reshape(-1, words), *(np.frombuffer(row[c], dtype=t) for c, t in (("sizes", np.int32), ("ids", np.int64), ("begins", np.int32))),
                )
                held.setdefault((tile.number >> TILE_BITS) // block, []).append(tile)
        if held:
            yield from result(pairs_of(held))

    return work.mapInArrow(run, schema)


def links(nodes: DataFrame, count: int, words: int, radius: int, least_ratio: float = 0.0, first_radius: int | None = None, tile_rows: int | None = None, first_words: int = 1) -> DataFrame:
    """(u, v): a spanning forest of the links among the ``count`` rows of ``nodes`` (node, fp, size), whose fingerprints are distinct.

    Two fingerprints are linked if they differ in ``radius`` bits at most, their first ``first_words`` words in ``first_radius`` at most, and
    the smaller size is at least ``least_ratio`` of the larger."""
    radii = (Radius(math.inf, radius, radius if first_radius is None else first_radius),)

    def result(pairs):
        for a, b in pairs:
            same = a.number == b.number
            base = 0 if same else len(a.fp)
            u, v = forest(base + len(b.fp), ((x, y + base) for x, y in near_rows(a, b, same, radii, least_ratio, first_words)))
            if len(u):
                ids = a.ids if same else np.concatenate((a.ids, b.ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return compared(nodes, count, words, radii, least_ratio, tile_rows, result, "u long, v long")


def numbered(rows: DataFrame, count: int, *order) -> DataFrame:
    """The rows with a column ``node``, which ascends in this order; cut, so that the numbers stay."""
    dealt = rows.repartitionByRange(max(1, -(-count // NODES)), *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("node", F.monotonically_increasing_id()), files_of(rows, count))


def near_duplicates(
    df: DataFrame,
    shingle: int = 4,
    words: int = 1,
    radius: int = 4,
    least_ratio: float = 0.0,
    first_radius: int | None = None,
    distinct: bool = False,
    tile_rows: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, size, component_id): component_id is the smallest doc_id that links reach, the own included."""
    every = cut_texts(fingerprints(df, shingle, words, distinct, id_col, text_col))
    key = ["fp", "size"] if least_ratio else ["fp"]  # without a ratio the size plays no part
    nodes = every.groupBy(*key).agg(F.min("doc_id").alias("least"), *([] if least_ratio else [F.min("size").alias("size")]))
    # The numbers ascend with the least ids, so that a component's least node has its least id.
    nodes = numbered(nodes, every.count(), F.col("least").asc_nulls_last(), "fp", "size")
    count = nodes.count()
    root = cut(components(links(nodes, count, words, radius, least_ratio, first_radius, tile_rows), count))
    reached = attached(root, nodes.select(F.col("node").alias("root"), F.col("least").alias("reached")), ["root"])
    placed = nodes.join(reached.drop("root"), "node", "left").select(*key, F.coalesce("reached", "least").alias("component_id"))
    return attached(every, placed, key).select("doc_id", "fp", "size", "component_id")


#: Similarity 0.8 or more, as a fraction, of sets of five-word shingles.
SHINGLE, SIMILAR, SIMILAR_OF = 5, 4, 5
#: Candidates for that, by fingerprints of 8 words. By the binomial model of the bits, a pair of similar sets is missed in about one case of
#: a billion by the whole distance and of a billion by that of the first 2 words; 4 shingles against 5 are the worst, at 19 % of the bits, all others
#: differ in at most 16 %. Sets of fewer than 4 shingles are similar only if they are equal.
WORDS, FIRST_WORDS, RADII = 8, 2, (Radius(5, 152, 53), Radius(math.inf, 136, 49))


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(words_of(text), SHINGLE))


def candidates(nodes: DataFrame, count: int, tile_rows: int | None = None) -> DataFrame:
    """(a_tile, b_tile, a_ids, b_ids, bits): a row for each pair of tiles with candidates, the nodes that have any, and
    one bit for each pair of those, packed and compressed: half a MB at most for a pair of tiles."""

    def result(pairs):
        for a, b in pairs:
            marked = None
            for u, v in near_rows(a, b, a.number == b.number, RADII, SIMILAR / SIMILAR_OF - 1e-9, FIRST_WORDS):
                marked = np.zeros((len(a.fp), len(b.fp)), dtype=bool) if marked is None else marked
                marked[u, v] = True
            if marked is not None:
                u, v = np.flatnonzero(marked.any(axis=1)), np.flatnonzero(marked.any(axis=0))
                bits = zlib.compress(np.packbits(marked[np.ix_(u, v)]).tobytes(), 1)
                row = [a.number, b.number, a.ids[u].tobytes(), b.ids[v].tobytes(), bits]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["a_tile", "b_tile", "a_ids", "b_ids", "bits"])

    return compared(nodes, count, WORDS, RADII, SIMILAR / SIMILAR_OF - 1e-9, tile_rows, result, "a_tile long, b_tile long, a_ids binary, b_ids binary, bits binary")


def similar_rows(a: list[np.ndarray], b: list[np.ndarray], marked: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that join what the marked pairs of similar sets join. A pair that is joined already is not looked at."""
    every = [*a, *b]
    size = np.array([len(x) for x in every])
    _, number = np.unique(np.concatenate(every), return_inverse=True)
    begin = np.cumsum(size) - size
    ids, node = np.unique(np.concatenate((a_ids, b_ids)), return_inverse=True)
    label = np.arange(len(ids))
    held = np.zeros(len(number) and int(number.max()) + 1, dtype=bool)
    out_u, out_v = [], []
    for i in range(len(a)):
        own = number[begin[i] : begin[i] + size[i]]
        js = np.flatnonzero(marked[i]) + len(a)
        js = js[label[node[js]] != label[node[i]]]
        if not len(js):
            continue
        held[own] = True
        first = np.cumsum(size[js]) - size[js]
        at = np.repeat(begin[js] - first, size[js]) + np.arange(size[js].sum())
        both = np.add.reduceat(held[number[at]], first, dtype=np.int64)
        held[own] = False
        js = js[SIMILAR_OF * both >= SIMILAR * (size[i] + size[js] - both)]
        if len(js):
            touched = np.unique(label[np.append(node[js], node[i])])
            label[np.isin(label, touched)] = touched[0]
            out_u.append(np.full(len(js), node[i]))
            out_v.append(node[js])
    if not out_u:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): a forest of the candidates ``found`` whose shingle sets (``sets``: node, hashes) are similar.

    A pair of tiles is checked at once and gets the set of each of its nodes once, however many pairs a node is in."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.unique(np.concatenate([np.frombuffer(row[c], dtype=np.int64) for c in ("a_ids", "b_ids")]))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(ids), row[c])) for c in ("a_tile", "b_tile")), pa.array(ids)], names=["a_tile", "b_tile", "node"])

    none = F.lit(None).cast("binary")
    sent = found.select("a_tile", "b_tile", F.lit(-1).cast("long").alias("node"), none.alias("hashes"), "a_ids", "b_ids", "bits")
    got = found.select("a_tile", "b_tile", "a_ids", "b_ids").mapInArrow(members, "a_tile long, b_tile long, node long").join(sets, "node")
    work = sent.unionByName(got.select("a_tile", "b_tile", "node", "hashes", none.alias("a_ids"), none.alias("b_ids"), none.alias("bits")))
    cores = found.sparkSession.sparkContext.defaultParallelism
    work = work.repartition(max(1, min(found.count(), 64 * UNITS_A_CORE * cores)), "a_tile", "b_tile").sortWithinPartitions("a_tile", "b_tile", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def checked(asked, held):
            a, b = (np.frombuffer(asked[c], dtype=np.int64) for c in ("a_ids", "b_ids"))
            marked = np.unpackbits(np.frombuffer(zlib.decompress(asked["bits"]), dtype=np.uint8), count=len(a) * len(b)).reshape(len(a), len(b)).astype(bool)
            u, v = similar_rows([held[k] for k in a.tolist()], [held[k] for k in b.tolist()], marked, a, b)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        asked, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["node"] < 0:
                    if asked is not None:
                        yield from checked(asked, held)
                    asked, held = row, {}
                else:
                    held[row["node"]] = np.frombuffer(row["hashes"], dtype="<u8")
        if asked is not None:
            yield from checked(asked, held)

    return work.mapInArrow(run, "u long, v long")


def _key(text_col: str):
    """What tells a row's text from other texts of the same id."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _similar(df: DataFrame, tile_rows: int | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, same; nodes: same, node, root, doc_id, key). ``same`` is the digest of a text's shingle set, of which
    there is one node. ``root`` is the component's least node; the order of nodes is that of the least (id, key) of their rows, rows without an id last."""

    def work(_, cols):
        sets = [shingle_set(t) for t in cols["text"]]
        fps = [majority(mixed(h, WORDS)).astype(">u8").tobytes() for h in sets]
        same = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        return {"doc_id": cols["doc_id"], "key": pa.array(cols["key"], pa.binary()), "same": pa.array(same, pa.binary()), "fp": pa.array(fps, pa.binary()), "size": [len(h) for h in sets]}

    texts = id_and_text(df, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _key("text").alias("key"))
    every = cut_texts(map_slices(texts, work, "doc_id bigint, key binary, same binary, fp binary, size int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    nodes = every.groupBy("same").agg(first, F.min("fp").alias("fp"), F.min("size").alias("size"))
    total = every.count()
    nodes = numbered(nodes, total, "first", "same")
    compared_nodes = nodes.where(F.col("size") >= SIMILAR).select("node", "fp", "size")
    files = files_of(df, total)
    found = cut(candidates(compared_nodes, compared_nodes.count(), tile_rows), files)
    wanted = found.select(F.explode(F.array("a_ids", "b_ids")).alias("ids")).mapInArrow(_ids, "node long").distinct()
    asked = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("w_id"), F.col("first.key").alias("w_key"))
    chosen = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = map_slices(chosen, lambda _, cols: {"node": cols["node"], "hashes": pa.array([shingle_set(t).astype("<u8").tobytes() for t in cols["text"]], pa.binary())}, "node bigint, hashes binary")
    linked_nodes = cut(verified(found, sets), files)
    root = components(linked_nodes, linked_nodes.count())
    placed = nodes.join(root, "node", "left").select("same", "node", F.coalesce("root", "node").alias("root"), F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    return every.select("doc_id", "key", "same"), cut(placed, files)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, dtype=np.int64))], names=["node"])


def similar_documents(df: DataFrame, tile_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id), a row for each row: component_id is the smallest doc_id that links reach, the own included; null if no row there has
    an id. Two texts are linked if their shingle sets have a similarity (Jaccard) of 0.8 or more: fingerprints give candidates, the sets decide."""
    rows, nodes = _similar(df, tile_rows, id_col, text_col)
    least = nodes.where("node = root").select("root", F.col("doc_id").alias("component_id"))
    placed = attached(nodes.select("same", "root"), least, ["root"]).select("same", "component_id")
    return attached(rows, placed, ["same"]).select("doc_id", "component_id")


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_rows: int | None = None) -> DataFrame:
    """One row of each group of near-duplicates (similarity 0.8 or more of five-word shingles), with all its columns.

    It is the row of the smallest id, rows without an id coming last; of texts of one id that with the least digest. Of equal ids and texts one row
    stays, the least by its columns as text. Rows are told apart by id and text, so an id may come with several unrelated texts, all of which stay."""
    rows, nodes = _similar(df, tile_rows, id_col, text_col)
    total = rows.count()
    files = files_of(df, total)
    # The texts, too, are left in few partitions: some a core, or one for FILE_ROWS rows.
    held = max(UNITS_A_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism), -(-total // FILE_ROWS))
    counted = cut(rows.groupBy("doc_id", "key", "same").agg(F.count(F.lit(1)).alias("n")), files)
    stays = nodes.select("same", F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), (F.col("node") == F.col("root")).alias("least"))
    found = attached(counted, stays, ["same"])
    verdicts = cut(found.select("doc_id", "key", "n", (F.col("least") & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))).alias("stays")), files)
    stem = "_".join(["own", *df.columns])  # clashes with no column
    own_id, own_key = f"{stem}_id", f"{stem}_key"
    as_own = lambda found: found.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key))
    matches = lambda: F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(own_id)) & (_key(f"`{text_col}`") == F.col(own_key))
    repeated = verdicts.where("stays AND n > 1")
    if not repeated.head(1):
        return df.join(as_own(verdicts.where("NOT stays")), matches(), "left_anti").coalesce(held)
    single = df.join(as_own(verdicts.where("NOT stays OR n > 1")), matches(), "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    again = df.join(as_own(repeated), matches()).groupBy(own_id, own_key).agg(F.min_by(whole, F.to_json(whole)).alias(stem))
    return single.unionAll(again.select(*[F.col(stem).getField(c).alias(c) for c in df.columns])).coalesce(held)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
