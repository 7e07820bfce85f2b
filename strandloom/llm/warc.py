"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions of whole files up to ``partitionBytes``, takes predicates on the record type
and on headers from the optimizer, parses a record's headers first and skips the payload of a record
that they reject (a seek in plain files) or that is not asked for (``payload`` = ``false``). Files
``.warc`` and ``.warc.gz`` (one gzip member a record) are read.

Writing makes files of up to ``fileBytes`` under names of their own. The driver lists them in a manifest of its own,
``_manifest-*.json``, once all tasks have committed; it gets its name in one move, and a folder with manifests is read by those
alone. So a lost executor's half-written file is never read, and two writes at once lose nothing.

Record ids are derived from the page's id and its payload, so that a task that runs again writes the same ids, and a revisit
refers to the id of its response. Rows that are equal in both are one capture and share their id.

Paths are local or of any file system that pyarrow opens by URI; the folder must be shared by all executors.

Edge cases of writing: a null payload is written as an empty one; null headers are left out and read as null; line
breaks in a header become spaces; repeated rows are a record each; an empty table makes an archive without records; columns
that aren't those of ``SCHEMA`` are ignored; a record's payload is held in memory by its task, whatever its length.

Edge cases of reading: what is wrong with a record is said in ``problem`` (else null), and reading goes on at the next line that begins a record.
A record that ends early has what there is as its payload; one without a usable Content-Length has none; lines that belong to
no record are a row without headers; an HTTP block without an end of its headers is a payload as a whole. Bytes of
headers that aren't UTF-8 are replaced. The payload of any record type but ``revisit`` is what follows HTTP headers, if there are such, or the block.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from strandloom.llm.common import HOT, cut, removed, scratch_path, table

#: Column, header, type: what a record's headers say.
HEADERS = (
    ("record_type", "WARC-Type", "string"),
    ("record_id", "WARC-Record-ID", "string"),
    ("target_uri", "WARC-Target-URI", "string"),
    ("date", "WARC-Date", "string"),
    ("payload_digest", "WARC-Payload-Digest", "string"),
    ("page_id", "X-Page-ID", "bigint"),
    ("refers_to", "X-Refers-To-Page-ID", "bigint"),
    ("payload_bytes", "X-Payload-Length", "bigint"),
)
SCHEMA = ", ".join(f"{c} {t}" for c, _, t in HEADERS) + ", problem string, payload binary"
ARROW = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, _, t in HEADERS] + [("problem", pa.string()), ("payload", pa.binary())])
MANIFEST = "_manifest-"
DIGEST = "sha256:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace of URLs
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def manifests(fs: pafs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests of a folder that hold, by name: those that no other replaces."""
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith(MANIFEST))
    found = {}
    for name in names:
        with fs.open_input_stream(f"{root}/{name}") as f:
            found[name] = json.loads(f.read())
    gone = {name for made in found.values() for name in made["replaces"]}
    return {name: made for name, made in found.items() if name not in gone}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcSource(DataSource):
    """Options: path; partitionBytes, payload (reading); fileBytes, compression none or gzip (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 128 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters):
        columns = {c for c, _, _ in HEADERS}
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in columns:
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, frozenset(values)) & frozenset(values)

    def partitions(self) -> list[Files]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Files([root])]
        listed = manifests(fs, root)
        if listed:
            files = [(f"{root}/{name}", size) for made in listed.values() for name, size in made["files"]]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = sorted((x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz")))
        parts, held = [], 0
        for path, size in files:
            if not parts or held + size > self.partition_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        schema = ARROW
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                plain = io.BufferedReader(raw, 1 << 20)
                for row in records(gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield batch(rows, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.removeprefix("-").isdecimal() else None


def _block(file, length: int, read: bool) -> tuple[bytes | None, str | None]:
    """(a record's block, if asked for, what is wrong with its end); leaves the file after the record."""
    data, problem = None, None
    try:
        if read:
            data, parts = b"", []
            left = length
            try:
                while left and (part := file.read1(min(left, 1 << 20))):
                    parts.append(part)
                    left -= len(part)
            finally:  # a compressed stream that ends early raises after what there is
                data = b"".join(parts)
            if left:
                return data, "record ends early"
        else:
            file.seek(length, 1)
        if file.read(4) != b"\r\n\r\n":
            problem = "no empty lines after the record"
    except (EOFError, OSError, zlib.error):
        problem = "record ends early"
    return data, problem


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes | None, str | None]:
    if headers.get("warc-type") == "revisit":
        return None, None
    if not headers.get("content-type", "").startswith("application/http"):
        return block, None
    head, end, data = block.partition(b"\r\n\r\n")
    return (data, None) if end else (head, "HTTP headers without an end")


def records(file, wanted: dict[str, frozenset], payload: bool) -> Iterator[tuple]:
    """The records that the headers let through; what they reject is passed over unread."""

    def passes(row: list) -> bool:
        return all(value in wanted[column] for value, (column, _, _) in zip(row, HEADERS, strict=True) if column in wanted)

    lost = False
    while True:
        try:
            line = file.readline()
        except (EOFError, OSError, zlib.error):  # the compressed stream ends early or is damaged
            line = b""
            if not lost and passes([None] * len(HEADERS)):
                yield (*[None] * len(HEADERS), "compressed stream ends early", None)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                if passes([None] * len(HEADERS)):
                    yield (*[None] * len(HEADERS), "not a record", None)
            continue
        lost, headers = False, {}
        try:
            while (line := file.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
        except (EOFError, OSError, zlib.error):
            line = b""
        row = [_number(headers.get(h.lower())) if kind == "bigint" else headers.get(h.lower()) for _, h, kind in HEADERS]
        keep, length = passes(row), _number(headers.get("content-length"))
        if length is None or length < 0:
            lost = True
            if keep:
                yield (*row, "no Content-Length" if line else "record ends early", None)
            continue
        block, problem = _block(file, length, payload and keep)
        lost = problem is not None
        if keep:
            data, other = (None, None) if block is None else _payload(headers, block)
            yield (*row, problem or other, data)


def record(row: dict) -> bytes:
    """One record: its headers, then for a response an HTTP block with the payload, for any other type but revisits the payload itself."""
    kind, key = row["record_type"], row.get("payload_digest") or hashlib.sha256(row.get("payload") or b"").hexdigest()
    named = {**row, "record_id": row.get("record_id") or record_id(kind, row.get("page_id"), key)}
    lines = [f"{header}: {' '.join(str(named[c]).splitlines())}" for c, header, _ in HEADERS if named.get(c) is not None]
    block = row.get("payload") or b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(block) + block
        lines.append("Content-Type: application/http; msgtype=response")
    elif kind == "revisit":
        block = b""
        lines.append(f"WARC-Profile: {PROFILE}")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: {record_id('response', row['refers_to'], key)}")
    lines.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{page_id}:{digest}')}>"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite
        self.file_bytes = int(options.get("fileBytes", 64 << 20))
        self.gzip = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for part in iterator:
            for row in part.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                        names[-1][1] = size
                    names.append([f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0])
                    out, size = fs.open_output_stream(f"{root}/{names[-1][0]}", compression=None, buffer_size=1 << 20), 0
                data = record(row)
                data = gzip.compress(data, 1) if self.gzip else data
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            names[-1][1] = size
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files = [name for m in messages if m for name in m.names]
        before = sorted(manifests(fs, root)) if self.overwrite else []
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/_part-{name}") as f:
            f.write(json.dumps({"files": files, "replaces": before}).encode())
        fs.move(f"{root}/_part-{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for name, _ in (name for m in messages if m for name in m.names):
            fs.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    """Registers the source and lets the optimizer hand it predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def write(df: DataFrame, path: str, **options) -> None:
    """Writes rows with the columns of ``SCHEMA`` (any may be missing but record_type) as records."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").options(**options).save(path)


def as_records(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record for each page. Of pages with equal payloads of at least ``least_bytes`` that with the smallest id is the
    response and the others revisit it; a page without an id never is referred to. Pages with the same id and payload
    are all responses or all revisits.

    Groups of equal payloads are found on digests alone, pre-aggregated; payloads are joined by page, so that a group of any
    size is spread over the tasks. The payloads of a digest that has over a thousandth of the pages aren't moved at all: there are fewer than
    a thousand of those, and they are broadcast with their smallest page."""
    page = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    keys = cut(page.where(F.col("payload_bytes") >= least_bytes).select("page_id", F.unhex("digest").alias("d")))
    total = keys.count()
    groups = keys.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    hot = groups.where(F.col("n") * HOT > max(total, 100 * HOT)).select(F.lower(F.hex("d")).alias("h_digest"), F.col("first").alias("refers_to"))
    again = keys.join(groups.where(F.col("n") * HOT <= max(total, 100 * HOT)).select("d", "first"), "d").where("page_id IS NULL OR page_id > first").select("page_id", "d", "first").distinct()
    r = again.select(F.col("page_id").alias("r_page"), F.lower(F.hex("d")).alias("h_digest"), F.col("first").alias("refers_to"))
    matches = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("h_digest"))
    if hot.head(1):
        few = F.broadcast(hot)
        hot_pages = page.join(few, F.col("digest") == F.col("h_digest")).withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")), F.col("refers_to")))
        rest = page.join(few, F.col("digest") == F.col("h_digest"), "left_anti").join(r, matches, "left").drop("r_page")
        joined = hot_pages.unionByName(rest)
    else:
        joined = page.join(r, matches, "left")
    again = F.col("refers_to").isNotNull()
    return joined.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit(DIGEST), F.col("digest")).alias("payload_digest"),
        "page_id",
        "refers_to",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(as_records(table(spark, sf_dir, "pages")), path, compression="gzip")
    back = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    found = cut(
        back.select(
            "page_id",
            F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(response, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", len(DIGEST) + 1, 64)).alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
    removed(spark, path)
    return found


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM g
"""
