"""Peak intervals: merging across cells, quality, gaps, length-matched background regions, classes.

A merged peak has the columns of ``MERGED``. The greedy merge of flows is sequential, but rows merge only where they overlap: a row that begins at or
after the end of all rows before it begins an island, and islands merge independently. Tasks get whole islands, some neighbours at once.
The background scan is one pass over rows in order that holds a queue of lengths; only rows with a gap or a length for the queue reach it.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGED = (
    "chrom string, start_pos bigint, end_pos bigint, start_min bigint, start_max bigint, end_min bigint, end_max bigint, "
    "cell_ids array<int>, values1 array<double>, values2 array<double>"
)
COLUMNS = [c.split()[0] for c in MERGED.split(", ")]


def singletons(peaks: DataFrame) -> DataFrame:
    """Peaks of single cells in the columns of merged ones."""
    whole = lambda c: F.col(c).cast("bigint")
    return peaks.select(
        "chrom", whole("start_pos").alias("start_pos"), whole("end_pos").alias("end_pos"), whole("start_pos").alias("start_min"), whole("start_pos").alias("start_max"),
        whole("end_pos").alias("end_min"), whole("end_pos").alias("end_max"), F.array(F.col("cell_id").cast("int")).alias("cell_ids"),
        F.array(F.col("value1").cast("double")).alias("values1"), F.array(F.col("value2").cast("double")).alias("values2"),
    )


def merge_status(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0: to merge, 1: a first, -1: b first; for intervals of one chromosome."""
    least = F.least(a_end - a_start, b_end - b_start)
    return (
        F.when(a_start >= b_end, -1)
        .when(b_start >= a_end, 1)
        .when((a_start >= b_start) & (a_end <= b_end), 0)
        .when((b_start >= a_start) & (b_end <= a_end), 0)
        .when(F.least(F.abs(a_start - b_start), F.abs(b_end - a_end)) < F.floor(least / 5), 0)
        .when(b_start > a_start, 1)
        .otherwise(-1)
    )


def _status(a: tuple, b: tuple) -> int:
    if a[1] >= b[2]:
        return -1
    if b[1] >= a[2]:
        return 1
    inside = (a[1] >= b[1] and a[2] <= b[2]) or (b[1] >= a[1] and b[2] <= a[2])
    near = min(abs(a[1] - b[1]), abs(a[2] - b[2])) < min(a[2] - a[1], b[2] - b[1]) // 5
    return 0 if inside or near else (1 if b[1] > a[1] else -1)


def _mean(x: int, n: int, y: int, m: int) -> int:
    """The weighted mean, rounded half to even."""
    return round((x * n + y * m) / (n + m))


def _means(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.rint((x * n + y * m) / (n + m)).astype(np.int64)


def _places(a: tuple, b: tuple, n, m, mean=_mean, low=min, high=max) -> tuple:
    """start_pos to end_max of two rows (or columns of rows) of n and m cells that merge."""
    return mean(a[1], n, b[1], m), mean(a[2], n, b[2], m), low(a[3], b[3]), high(a[4], b[4]), low(a[5], b[5]), high(a[6], b[6])


def _merged(a: tuple, b: tuple) -> tuple:
    return (a[0], *_places(a, b, len(a[7]), len(b[7])), *([*a[k], *b[k]] for k in (7, 8, 9)))


def merged_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and start_pos to end_max of what each pair of peaks of single cells (a_start_pos, a_end_pos, b_start_pos, b_end_pos) that merge becomes.

    Pairs don't depend on each other: they stay where they are, and many are merged at once."""
    made = COLUMNS[1:7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_start_pos", "a_end_pos", "b_start_pos", "b_end_pos")}
            a, b = ((None, start, end, start, start, end, end) for start, end in ((column[f"{p}_start_pos"], column[f"{p}_end_pos"]) for p in "ab"))
            found = _places(a, b, 1, 1, _means, np.minimum, np.maximum)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, found)], names=[*keys, *made])

    places = [F.col(c).cast("bigint").alias(c) for c in ("a_start_pos", "a_end_pos", "b_start_pos", "b_end_pos")]
    kinds = [f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys]
    return pairs.select(*keys, *places).mapInArrow(run, ", ".join([*kinds, *(f"{c} bigint" for c in made)]))


def merge_flows(first: Iterator[tuple], second: Iterator[tuple], emulate_tail_dup: bool = False) -> Iterator[tuple]:
    """Two flows in order to one: heads that may merge do, else the first in order goes. Merged rows are not merged again.

    ``emulate_tail_dup`` repeats the second flow's row when a merge uses up the first flow."""
    a, b = next(first, None), next(second, None)
    while a is not None and b is not None:
        status = _status(a, b)
        if status == 0:
            yield _merged(a, b)
            a = next(first, None)
            if not (emulate_tail_dup and a is None):
                b = next(second, None)
        elif status == 1:
            yield a
            a = next(first, None)
        else:
            yield b
            b = next(second, None)
    yield from _rest(a, first)
    yield from _rest(b, second)


def _rest(head: tuple | None, flow: Iterator[tuple]) -> Iterator[tuple]:
    if head is not None:
        yield head
        yield from flow


def merge_join(left: DataFrame, right: DataFrame, emulate_tail_dup: bool = False) -> DataFrame:
    """The greedy one-to-one full outer merge of two flows, each chromosome in order of (start, end).

    ``emulate_tail_dup`` is a matter of a flow's end, so it takes a chromosome as a whole."""
    return _tournament(_flows([left, right]), 2, emulate_tail_dup)


def _flows(flows: list[DataFrame]) -> DataFrame:
    rows = [flow.select(*COLUMNS, F.lit(k).alias("flow")) for k, flow in enumerate(flows)]
    return functools.reduce(DataFrame.unionByName, rows)


def merge_all(flows: list[DataFrame]) -> DataFrame:
    """A tournament: the first two flows merge and queue up behind the others until one is left.

    A merged flow keeps the order in which the merge gave its rows, so all rounds of an island are one task's generators."""
    if not flows:
        raise ValueError("no flows to merge")
    return _tournament(_flows(flows), len(flows))


def merged_peaks(peaks: DataFrame, cells: int | None = None, chrom: str | None = None) -> DataFrame:
    """Peaks of the cells 0 to ``cells`` - 1 (all by default), each cell a flow, merged in the tournament's order."""
    if cells is None:
        cells = (peaks.agg(F.max("cell_id").alias("most")).first().most or 0) + 1
    wanted = peaks.where(F.col("cell_id") < cells)
    rows = singletons(wanted if chrom is None else wanted.where(F.col("chrom") == chrom))
    return _tournament(rows.withColumn("flow", F.element_at("cell_ids", 1)), cells)


#: Islands that begin within this many positions go to one task together.
NEIGHBOURS = 1 << 20


def islands(rows: DataFrame) -> DataFrame:
    """Adds ``island``: where the row's island begins. A chromosome's rows stream through one running maximum."""
    order = Window.partitionBy("chrom").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("begins", F.when(before.isNull() | (F.col("start_pos") >= before), F.col("start_pos")))
    return marked.withColumn("island", F.max("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("begins")


def _tournament(rows: DataFrame, n: int, emulate_tail_dup: bool = False) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        flows: list[list[tuple]] = [[] for _ in range(n)]
        for *r, flow in part[[*COLUMNS, "flow"]].itertuples(index=False, name=None):
            flows[flow].append(tuple(r))
        queue: list = [iter(sorted(f, key=lambda r: (r[1], r[2], list(r[7]), list(r[8])))) for f in flows]
        while len(queue) > 1:
            queue.append(merge_flows(queue.pop(0), queue.pop(0), emulate_tail_dup))
        return pd.DataFrame(list(queue[0]), columns=COLUMNS)

    if emulate_tail_dup:
        return rows.groupBy("chrom").applyInPandas(run, MERGED)
    grouped = islands(rows).withColumn("near", F.floor(F.col("island") / NEIGHBOURS))
    return grouped.groupBy("chrom", "near").applyInPandas(run, MERGED)


def mean_value1() -> Column:
    return F.aggregate("values1", F.lit(0.0), lambda s, v: s + v) / F.size("values1")


def is_good(min_cells: int = 2, min_value: float = 200.0, min_size: int = 100) -> Column:
    return (F.size("cell_ids") >= min_cells) & (mean_value1() >= min_value) & (F.col("end_pos") - F.col("start_pos") >= min_size)


def is_strict() -> Column:
    """Whether all cells of a merged peak begin at one place and end at one."""
    return (F.col("start_min") == F.col("start_max")) & (F.col("end_min") == F.col("end_max"))


def peak_regions(merged: DataFrame, **limits) -> DataFrame:
    return merged.where(is_good(**limits)).select("chrom", F.col("start_min").alias("start"), (F.col("end_max") - F.col("start_min")).alias("size"))


def gaps(merged: DataFrame) -> DataFrame:
    """(chrom, gap_start, gap_end): room before each peak, from the end of the one before it in order (0 for a chromosome's first)."""
    order = Window.partitionBy("chrom").orderBy("start_pos", "end_pos")
    before = F.coalesce(F.lag("end_max").over(order), F.lit(0))
    return merged.select("chrom", before.alias("gap_start"), F.col("start_min").alias("gap_end")).where("gap_end > gap_start")


REGION = "kind string, chrom string, start bigint, size bigint"


def regions(merged: DataFrame, min_cells: int = 2, min_value: float = 200.0, min_size: int = 100, seed: int | None = None, queue: str = "all") -> DataFrame:
    """Good peaks, and background regions of the same lengths placed in the gaps between all peaks.

    Each good peak's length waits in a queue; a gap longer than ``min_size`` takes the queue's head if it is shorter than
    the room that is left, at the gap's start or (with a seed) at a random place in it, and so on. Peaks are scanned in order of (start, end).
    The queue is one for all chromosomes, taken in their order (chr2 before chr10), and so one task's; ``queue='chromosome'`` has one
    for each, whose tasks are independent. Either way rows stream through the task, which holds the lengths that wait."""
    if queue not in ("all", "chromosome"):
        raise ValueError(f"unknown queue {queue}")
    place = ["start_pos", "end_pos", "start_min", "end_max"]
    slim = merged.select("chrom", *place, is_good(min_cells, min_value, min_size).alias("good"))
    before = F.coalesce(F.lag("end_max").over(Window.partitionBy("chrom").orderBy(*place)), F.lit(0))
    number = F.coalesce(F.regexp_extract("chrom", r"(\d+)$", 1).try_cast("int"), F.lit(2**31 - 1))
    rows = slim.withColumns({"last": before, "number": number}).where(F.col("good") | (F.col("start_min") - F.col("last") > min_size))
    rows = rows.repartition(1) if queue == "all" else rows.repartition("chrom")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rnd, waiting = None, Random(f"{seed}"), deque()
        for batch in batches:
            out = []
            for chrom, start, end, last, good in batch[["chrom", "start_min", "end_max", "last", "good"]].itertuples(index=False, name=None):
                if queue == "chromosome" and chrom != now:
                    now, rnd, waiting = chrom, Random(f"{seed}:{chrom}"), deque()
                while waiting and start - last > min_size and waiting[0] < start - last:
                    size = waiting.popleft()
                    at = last if seed is None else rnd.randrange(last, start - size)
                    out.append(("noise", chrom, at, size))
                    last = at + size
                if good:
                    out.append(("peak", chrom, start, end - start))
                    waiting.append(end - start)
            yield pd.DataFrame(out, columns=["kind", "chrom", "start", "size"])

    return rows.sortWithinPartitions("number", "chrom", *place).mapInPandas(scan, REGION)


def region_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


def classify(peaks: DataFrame) -> DataFrame:
    """Adds status by value2 against the greatest one: above nine tenths Present, below one tenth NotPresent, else Unknown."""
    most = peaks.agg(F.max("value2").alias("most"))  # one row
    status = F.when(F.col("value2") > 0.9 * F.col("most"), "Present").when(F.col("value2") < 0.1 * F.col("most"), "NotPresent").otherwise("Unknown")
    return peaks.crossJoin(F.broadcast(most)).withColumn("status", status).drop("most")


def status_of(present: Column) -> Column:
    return F.when(present.isNull(), "Unknown").when(present, "Present").otherwise("NotPresent")


def bars(merged: DataFrame, top: int, low: int, high: int) -> DataFrame:
    """(chrom, rank, mid, value): the rounded greatest values of each peak within the range, as one series a rank."""
    inside = merged.where((F.col("start_pos") >= low) & (F.col("end_pos") <= high))
    return inside.select("chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("mid"), F.posexplode(F.slice(F.sort_array("values1", False), 1, top)).alias("rank", "v")).select(
        "chrom", F.col("rank").cast("bigint").alias("rank"), F.col("mid").cast("bigint").alias("mid"), F.rint("v").cast("bigint").alias("value")
    )


def bar_bounds(merged: DataFrame, low: int, high: int) -> DataFrame:
    """(chrom, min_pos, max_pos, max_value) of the peaks that ``bars`` shows: their outermost places, and the greatest value without its fraction."""
    inside = merged.where((F.col("start_pos") >= low) & (F.col("end_pos") <= high))
    return inside.groupBy("chrom").agg(F.min("start_min").alias("min_pos"), F.max("end_max").alias("max_pos"), F.max(F.array_max("values1")).cast("bigint").alias("max_value"))


def overlapping(left: DataFrame, right: DataFrame, width: int = 4096) -> DataFrame:
    """Pairs of intervals (a_*, b_*) of one chromosome that overlap or touch, by equal bins of ``width``; each pair once."""
    binned = lambda f, p: f.select(*[F.col(c).alias(f"{p}_{c}") for c in f.columns], F.col("chrom").alias("chrom"), F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor(F.col("end_pos") / width))).alias("bin"))
    pairs = binned(left, "a").join(binned(right, "b"), ["chrom", "bin"])
    meet = (F.col("a_start_pos") <= F.col("b_end_pos")) & (F.col("b_start_pos") <= F.col("a_end_pos"))
    own = F.col("bin") == F.floor(F.greatest("a_start_pos", "b_start_pos") / width)
    return pairs.where(meet & own).drop("bin")
