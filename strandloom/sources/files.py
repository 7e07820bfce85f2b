"""Files: FASTA, peak tables, manifests, packed chromosomes, graph and element tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import sequence as S

#: Columns of the peak tables, in file order; fixed values of the format.
PEAK_COLUMNS = ("chrom", "start_pos", "end_pos", "name", "score", "strand", "value1", "value2", "q_value")
PEAK_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c.endswith("_pos") else T.FloatType() if c.startswith("value") else T.StringType()) for c in PEAK_COLUMNS]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines in file order by (block, at). Compressed files are read too."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )


def read_fasta(spark: SparkSession, path: str, chrom: str | None = None, unknown: str = "A", soft_mask: bool = False) -> DataFrame:
    """(chrom, start_pos, seq), a row for each line.

    ``unknown`` replaces N (``A``, or ``N`` to keep it). ``soft_mask`` keeps lower case, where ``n`` is then an error. A file's first line
    must begin with ``>``, or with ``chrom`` be ``>`` and that name in lower case; its text is the name of the chromosome.
    Later lines that begin with ``>`` are passed over. Any symbol but ACGTN raises, and so does a file without its first line.

    A line's place is the sum of the lengths before it: within its file block, plus the blocks before. Only the blocks'
    totals meet in one task per file.
    """
    lines = _lines(spark, path)
    header = F.col("line").startswith(">")
    first = lines.groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("title"))
    size = F.when(header, 0).otherwise(F.length("line"))
    inner = Window.partitionBy("file", "block").orderBy("at")
    placed = lines.withColumn("before", F.sum(size).over(inner) - size)
    totals = lines.groupBy("file", "block").agg(F.sum(size).alias("total"))
    blocks = totals.select("file", "block", (F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")).alias("offset"))
    right = F.col("title").startswith(">") if chrom is None else F.col("title") == ">" + chrom.lower()
    name = F.when(right, F.substring("title", 2, 1_000_000) if chrom is None else F.lit(chrom)).otherwise(F.raise_error(F.concat(F.lit("unexpected first line: "), F.col("title"))))
    allowed = "ACGTNacgt" if soft_mask else "ACGTNacgtn"
    seq = F.when(F.translate("line", allowed, "") == "", F.col("line")).otherwise(F.raise_error(F.concat(F.lit("unexpected symbol in: "), F.col("line"))))
    seq = seq if soft_mask else F.upper(seq)
    return (
        placed.where(~header)
        .join(blocks, ["file", "block"])
        .join(F.broadcast(first), "file")  # a row a file
        .select(name.alias("chrom"), (F.col("before") + F.col("offset")).cast("bigint").alias("start_pos"), F.translate(seq, "N", unknown).alias("seq"))
    )


def write_chromosomes(chunks: DataFrame, path: str) -> None:
    """Parquet by chromosome; reading one prunes the others."""
    chunks.write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema("chunk_no long, start_pos long, seq string, chrom string").parquet(path)


def cached_chromosomes(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built by ``build()`` if it is not there yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        write_chromosomes(build(), path)
    return read_chromosomes(spark, path)


def read_peaks(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """(chrom, start_pos, end_pos, value1, value2) of narrow or broad peak files."""
    peaks = spark.read.csv(path, sep="\t", schema=PEAK_SCHEMA).select("chrom", "start_pos", "end_pos", "value1", "value2")
    return peaks if chrom is None else peaks.where(F.col("chrom") == chrom)


def write_peaks(peaks: DataFrame, path: str) -> None:
    """Peaks as files of the narrow-peak format; what the table doesn't hold is written as the format's blanks."""
    blank = {"name": F.lit("."), "score": F.lit(0), "strand": F.lit("."), "q_value": F.lit(-1)}
    peaks.select(*[blank[c].alias(c) if c in blank else F.col(c) for c in PEAK_COLUMNS], F.lit(-1).alias("summit")).write.csv(path, sep="\t")


def workspace(spark: SparkSession) -> str:
    """A folder for intermediate files: the session's shared checkpoint folder; a local session without one gets a temporary one."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared or not context._jsc.sc().getCheckpointDir().isEmpty():
        return shared or context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="strandloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def parse_manifest(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds file_name and attrs: the text before the first tab, and the ``key=value`` pieces after it."""
    parts = F.split(line_col, "\t")
    pieces = F.filter(F.split(F.array_join(F.slice(parts, 2, 1_000_000), "; "), "; "), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2).alias("value")))
    return lines.withColumn("file_name", F.get(parts, 0)).withColumn("attrs", F.map_from_entries(pairs))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    numbered = _lines(spark, path).where("line <> ''").withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")).cast("bigint"))
    return parse_manifest(numbered.select("line_no", "line"))


def matching_files(parsed: DataFrame, wanted: dict[str, str], limit: int | None = None) -> DataFrame:
    """The first files, in manifest order, that have all the attributes; a missing attribute does not match."""
    for key, value in wanted.items():
        parsed = parsed.where(F.try_element_at("attrs", F.lit(key)) == value)
    return parsed if limit is None else parsed.orderBy("line_no").limit(limit)


def single_file(parsed: DataFrame, wanted: dict[str, str]) -> str:
    """The one file with all the attributes; none or several are an error."""
    found = matching_files(parsed, wanted).select("file_name").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no file' if not found else 'several files'} with {wanted}")
    return found[0].file_name


def graph_nodes(words: DataFrame) -> DataFrame:
    return words.select((F.col("id") + 1).cast("bigint").alias("id"), F.col("word").alias("label"), F.col("cnt").cast("bigint").alias("size"))


def graph_edges(edges: DataFrame, least: int = 5) -> DataFrame:
    """Edges of at least that weight, renumbered from 1; the weight counts from 1 too."""
    return edges.where(F.col("weight") >= least).select(
        (F.col("id1") + 1).cast("bigint").alias("source"), (F.col("id2") + 1).cast("bigint").alias("target"), F.col("mask").alias("label"),
        (F.col("weight") - least + 1).cast("bigint").alias("weight"), F.lit("Undirected").alias("type"), F.col("direction").cast("bigint").alias("direction"),
    )


def element_log(words: DataFrame) -> DataFrame:
    turned = [S.oriented("word", d) for d in (2, 1, 3)]
    return words.select(
        F.col("id").cast("bigint").alias("id"), F.col("cnt").cast("bigint").alias("grp_size"), F.length("word").cast("bigint").alias("chain_len"), F.col("word").alias("original"),
        turned[0].alias("inversed"), turned[1].alias("reversed"), turned[2].alias("revinversed"),
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
