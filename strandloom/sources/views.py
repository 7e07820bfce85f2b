"""The engine's inputs derived from the driver's tables: fragments, peaks, a manifest, a genome, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S

CHUNK = 64
WORD_LENGTH, WORDS = 10, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (a small file of one row group, say) dealt over all cores; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag_id, seq): the nucleotide letters of each document, in upper case."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("frag_id"), F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("seq"))


def labelled_seqs(spark: SparkSession, sf_dir: str, quality: int) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(F.col("quality") == quality).select(F.col("doc_id").alias("frag_id"))
    return seqs(spark, sf_dir).join(labels, "frag_id")


def pos_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_seqs(spark, sf_dir, 1)


def neg_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_seqs(spark, sf_dir, 0)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, chrom, cell_id, start_pos, end_pos, value1, value2): an interval for each event; a cell for each event type."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    below = kinds.alias("a").join(kinds.select(F.col("event_type").alias("other")).alias("b"), F.col("other") < F.col("event_type"), "left")
    cells = below.groupBy("event_type").agg(F.count("other").alias("cell_id"))  # one row an event type
    start = F.expr("div(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts), 20)")
    return events.join(F.broadcast(cells), "event_type").select(
        "event_id",
        F.concat(F.lit("chr"), (F.col("user_id") % 22 + 1).cast("string")).alias("chrom"),
        F.col("cell_id").cast("int").alias("cell_id"),
        start.alias("start_pos"),
        (start + 100 + F.col("event_id") * 7919 % 400).alias("end_pos"),
        (F.col("value") * 10).alias("value1"),
        F.col("value").alias("value2"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): a manifest line for each part."""
    attrs = F.concat(F.col("p_name"), F.lit("\tbrand="), F.col("p_brand"), F.lit("; type="), F.col("p_type"), F.lit("; size="), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), attrs.alias("line"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, chunk_no, start_pos, seq): each document's letters as a chromosome in chunks of 64."""
    whole = seqs(spark, sf_dir).where(F.length("seq") > 0)
    return chunked(whole.select(F.col("frag_id").cast("string").alias("chrom"), "seq"))


def chunked(whole: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chrom, seq) cut into rows of ``size`` symbols."""
    starts = F.sequence(F.lit(0), F.expr(f"div(length(seq) - 1, {size})").cast("int"))
    return whole.where(F.length("seq") > 0).select("chrom", F.explode(F.transform(starts, lambda n: F.struct(n.alias("chunk_no"), F.substr(F.col("seq"), n * size + 1, F.lit(size)).alias("seq")))).alias("c")).select(
        "chrom", F.col("c.chunk_no").cast("bigint").alias("chunk_no"), (F.col("c.chunk_no") * size).cast("bigint").alias("start_pos"), F.col("c.seq").alias("seq")
    )


def rechunked(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk_no, start_pos, seq) in chunks of ``size`` from pieces (chrom, start_pos, seq) of any sizes that cover a chromosome without gaps.

    A piece is cut where chunks begin; only the parts of one chunk ever meet."""
    first, last = F.floor(F.col("start_pos") / size), F.floor((F.col("start_pos") + F.length("seq") - 1) / size)
    cut = pieces.where(F.length("seq") > 0).select("chrom", "start_pos", "seq", F.explode(F.sequence(first, last)).alias("chunk_no"))
    low = F.greatest(F.col("chunk_no") * size, F.col("start_pos"))
    high = F.least((F.col("chunk_no") + 1) * size, F.col("start_pos") + F.length("seq"))
    part = F.substr(F.col("seq"), (low - F.col("start_pos") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.groupBy("chrom", "chunk_no").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("seq")))).alias("p"))
    return parts.select("chrom", F.col("chunk_no").cast("bigint").alias("chunk_no"), (F.col("chunk_no") * size).cast("bigint").alias("start_pos"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, word, cnt): the 40 most frequent words of ten symbols of the positive fragments; ties by word."""
    found = pos_seqs(spark, sf_dir).select(F.explode(S.kmers("seq", WORD_LENGTH)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    top = found.where(S.is_complex("word")).orderBy(F.col("cnt").desc(), "word").limit(WORDS)
    # WORDS rows: numbering them takes one small task.
    return numbered(top)


def numbered(few: DataFrame) -> DataFrame:
    """Ids from 0 by count (descending) and word; for a bounded number of rows."""
    gathered = few.agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("k"), "word"))).alias("every"))
    return gathered.select(F.posexplode("every").alias("id", "w")).select("id", F.col("w.word").alias("word"), (-F.col("w.k")).alias("cnt"))
