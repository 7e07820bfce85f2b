"""Slices of chromosomes kept in chunks, and runs of unknown symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_slice(chunks: DataFrame, wanted: DataFrame, size: int = 64, keys: tuple[str, ...] = ("chrom", "start", "size")) -> DataFrame:
    """(chrom, start, size, seq) for the ranges (chrom, start, size): an equi-join on chunk numbers, then pieces in order."""
    first, last = F.expr(f"div(start, {size})"), F.expr(f"div(start + size - 1, {size})")
    asked = wanted.where("size > 0").select(*keys, F.explode(F.sequence(first, last)).alias("chunk_no"))
    low = F.greatest(F.col("start"), F.col("start_pos")) - F.col("start_pos")
    high = F.least(F.col("start") + F.col("size"), F.col("start_pos") + F.length("seq")) - F.col("start_pos")
    piece = F.substr("seq", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    pieces = asked.join(chunks, ["chrom", "chunk_no"]).select(*keys, F.struct("chunk_no", piece.alias("piece")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), "")
    return pieces.groupBy(*keys).agg(joined.alias("seq"))


def whole(chunks: DataFrame) -> DataFrame:
    """(chrom, seq) put together again: a whole chromosome in one row, which its 2 GB bound; ``range_slice`` reads parts of any."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "seq"))), lambda x: x["seq"]), "")
    return chunks.groupBy("chrom").agg(joined.alias("seq"))


def append(chunks: DataFrame, more: DataFrame, size: int = 64) -> DataFrame:
    """Chunks of each chromosome with ``more`` (chrom, seq) after them. Only a chromosome's last chunk and what is new are put together;
    all other chunks stay as they are."""
    from strandloom.sources.views import rechunked

    end = chunks.groupBy("chrom").agg(F.max("chunk_no").alias("chunk_no")).join(chunks, ["chrom", "chunk_no"])
    after = more.select("chrom", F.col("seq").alias("new")).join(end.select("chrom", (F.col("start_pos") + F.length("seq")).alias("at")), "chrom", "left")
    new = after.select("chrom", F.coalesce("at", F.lit(0)).alias("start_pos"), F.col("new").alias("seq"))
    last = end.join(after.where("new <> ''").select("chrom"), "chrom", "left_semi").select("chrom", "start_pos", "seq")
    whole = chunks.join(last.select("chrom", "start_pos"), ["chrom", "start_pos"], "left_anti")
    return whole.unionByName(rechunked(last.unionByName(new), size).select(*whole.columns))


def runs(seqs: DataFrame, symbols: str, id_col: str = "frag_id", seq_col: str = "seq") -> DataFrame:
    """(id, start, length, known): the run-length form of whether each symbol is among ``symbols``."""
    flags = F.transform(F.sequence(F.lit(1), F.length(seq_col)), lambda i: F.substr(F.col(seq_col), i, F.lit(1)))
    rows = seqs.where(F.length(seq_col) > 0).select(id_col, F.posexplode(flags).alias("pos", "symbol")).withColumn("known", F.lit(symbols).contains(F.col("symbol")))
    order = Window.partitionBy(id_col).orderBy("pos")
    changes = rows.withColumn("new", F.coalesce((F.col("known") != F.lag("known").over(order)).cast("int"), F.lit(1)))
    return changes.withColumn("run", F.sum("new").over(order)).groupBy(id_col, "run", "known").agg(F.min("pos").cast("bigint").alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def from_runs(found: DataFrame, id_col: str = "frag_id") -> DataFrame:
    """(id, mask): 1 for each known symbol and 0 for each other."""
    piece = F.expr("repeat(if(known, '1', '0'), cast(length as int))")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("p")))), lambda x: x["p"]), "")
    return found.groupBy(id_col).agg(joined.alias("mask"))
