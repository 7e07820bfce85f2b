"""Byte-level BPE encoding and decoding with tiktoken over a local rank file.

Edge cases: a null text counts as empty (no ids, empty bytes); ties cannot arise, as the
vocabulary fixes one encoding; repeated rows are each encoded; an empty table gives an
empty result; other columns are ignored.

A long text is cut before it reaches the library, so that no regular expression works on more than
``CHUNK_CHARS`` plus one run without a safe place. A cut is made only between a word character and a
space: no match of the pattern holds a space after another character, and the pattern looks ahead only
past white space, so the pieces' ids, joined, are the whole text's ids.

The pattern's look-ahead past white space backtracks once a character, which the library refuses on runs
of about a million. Runs of ``LONG_RUN`` characters or more never reach it: of such a run all but the
last character are one match (all of them at the text's end), which is merged as a whole. So there is no
limit to a text's length but memory, a few times the text.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, map_slices

CHUNK_CHARS = 16_384
LONG_RUN = 4096
_SAFE = re.compile(r"[^\W_](?= )")
#: Unicode's White_Space, which is what the pattern's \s means (Python's holds four control characters more).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EVERYTHING = r"[\s\S]+"


@functools.cache
def encoding(rank_path: str, pattern: str):
    """Two tiktoken encodings of a rank file, without special tokens: one that splits by the pattern, one that takes a text as one match."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tuple(tiktoken.Encoding("local", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, _EVERYTHING))


def safe_pieces(text: str, chunk_chars: int = CHUNK_CHARS) -> list[str]:
    """The text in pieces of about ``chunk_chars``, cut only where tokens must end."""
    pieces, start = [], 0
    while len(text) - start > chunk_chars:
        found = _SAFE.search(text, start + chunk_chars - 1)
        if not found:
            break
        pieces.append(text[start : found.end()])
        start = found.end()
    pieces.append(text[start:])
    return pieces


@functools.cache
def long_runs(least: int) -> re.Pattern:
    return re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{least},}}")


def without_long_runs(text: str, long_run: int = LONG_RUN) -> list[tuple[str, bool]]:
    """The text in parts (part, whether it is one match of white space): long runs of white space stand alone."""
    parts, start = [], 0
    if len(text) >= long_run:
        for run in long_runs(long_run).finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            parts += [(text[start : run.start()], False), (text[run.start() : stop], True)]
            start = stop
    return [*parts, (text[start:], False)]


def encode_text(enc, text: str, chunk_chars: int = CHUNK_CHARS, long_run: int = LONG_RUN) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers. ``enc`` is a pair of encodings (``encoding``)."""
    by_pattern, whole = enc
    parts = []
    for part, one_match in without_long_runs(text, max(2, long_run)):
        if one_match:
            parts.append(whole.encode_to_numpy(part, disallowed_special=()))
        else:
            parts += [by_pattern.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(part, chunk_chars) if p]
    return b"".join(np.asarray(ids, dtype="<u4").tobytes() for ids in parts)


def decode_ids(enc, packed: bytes) -> bytes:
    """The raw bytes of packed ids; they need not be valid UTF-8."""
    return enc[0].decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers."""

    def work(enc, cols):
        packed = [encode_text(enc, t, chunk_chars) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_tokens": [len(p) // 4 for p in packed], "ids": packed}

    source = id_and_text(df, id_col, text_col)
    return map_slices(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary", lambda: encoding(rank_path, pattern))


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the raw bytes of packed ids; null ids decode to no bytes."""

    def work(enc, cols):
        return {"doc_id": cols["doc_id"], "decoded": [decode_ids(enc, p) for p in cols["ids"]]}

    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return map_slices(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary", lambda: encoding(rank_path, pattern))


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): encoding, and decoding of the very ids, in one pass over the texts."""

    def work(enc, cols):
        packed = [encode_text(enc, t, chunk_chars) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "n_tokens": [len(p) // 4 for p in packed],
            "ids": pa.array(packed, pa.binary()),
            "decoded": pa.array([decode_ids(enc, p) for p in packed], pa.binary()),
        }

    source = id_and_text(df, id_col, text_col)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    return map_slices(source, work, schema, lambda: encoding(rank_path, pattern))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from strandloom.llm.common import table

    done = round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
