"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, the first permuted (rotated) twice and the second once; a text's vector bundles
(adds) the vectors of its trigrams; a language's prototype bundles its training texts, each at
weight one. A text gets the language whose prototype has the largest cosine.

Both are sums over trigrams, so a text is first reduced to trigram counts and then bundled by one
small matrix product: for each pair of leading letters the counts of the third letter, times the
letter vectors, bound with the pair's vector. Prototypes are bundled from counts in the same way.
The prototypes are languages x dimensions numbers, whatever the size of the corpus.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; equal cosines go to the
language that sorts first; repeated rows each count and are each predicted; without any training
row every text is ``und``; texts may be of any length; an empty table gives an empty result; other columns are ignored.
In the query, ``held_out`` of a row without an id is null, and such rows don't train.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SLICE_ROWS, id_and_text, map_slices, sum_blocks

#: Letter classes: 0 is a gap between words, 1 to 26 are a to z, other letters share the rest by code point.
CLASSES = 64
DIMENSIONS = 512
SEED = 20_240_607
#: Languages whose counts a worker holds before it bundles them.
HELD_LANGUAGES = 16


@functools.cache
def letter_classes() -> np.ndarray:
    classes = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            classes[c] = c - 96 if 97 <= c <= 122 else 27 + c % (CLASSES - 27)
    return classes


@functools.cache
def vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the letters, and of each pair of leading letters (bound, permuted)."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), (CLASSES, dimensions))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return letters, (first[:, None, :] * second[None, :, :]).reshape(CLASSES * CLASSES, dimensions)


def trigrams(text: str) -> np.ndarray:
    """Codes of the text's trigrams; runs of anything but letters are one gap. Empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = letter_classes()[points]
    if not found.any():
        return np.empty(0, dtype=np.int64)
    padded = np.concatenate(([0], found, [0])).astype(np.int32)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    kept = padded[keep]
    return (kept[:-2] << 12) | (kept[1:-1] << 6) | kept[2:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) > 20_000:
        counts = np.bincount(codes, minlength=CLASSES**3)
        seen = np.flatnonzero(counts)
        return seen, counts[seen]
    return np.unique(codes, return_counts=True)


def bundle(codes: np.ndarray, weights: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of the trigrams' vectors; codes ascend."""
    letters, pairs = vectors(dimensions)
    pair = codes >> 6
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    row = np.zeros(len(codes), dtype=np.int64)
    row[starts[1:]] = 1
    third = np.zeros((len(starts), CLASSES), dtype=np.float32)
    third[np.cumsum(row), codes & 63] = weights
    return np.einsum("ij,ij->j", third @ letters, pairs[pair[starts]])


def prototypes(df: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Each language's unit prototype, from all rows with a language."""

    def learn(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([bundle(seen, counts[seen], dimensions).astype("<f8").tobytes()], pa.binary())], names=["lang", "block"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cols = batch.slice(at, SLICE_ROWS).to_pydict()
                for text, lang in zip(cols["text"], cols["lang"], strict=True):
                    codes = trigrams(text)
                    if not len(codes):
                        continue
                    if lang not in held:
                        if len(held) >= HELD_LANGUAGES:
                            yield from flush()
                        held[lang] = np.zeros(CLASSES**3)
                    seen, counts = counted(codes)
                    held[lang][seen] += counts / len(codes)
        yield from flush()

    rows = df.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = sum_blocks(rows.mapInArrow(learn, "lang string, block binary"), "lang").collect()  # one row a language
    made = {r.lang: np.frombuffer(r.block, dtype="<f8") for r in sorted(found, key=lambda r: r.lang)}
    return {lang: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for lang, v in made.items()}


def predict(df: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the cosine with the language's prototype, at least 0."""
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]) if names else None

    def work(_, cols):
        langs, scores = [], []
        for text in cols["text"]:
            codes = trigrams(text)
            if matrix is None or not len(codes):
                langs.append("und")
                scores.append(0.0)
                continue
            vector = bundle(*counted(codes), dimensions)
            cosines = matrix @ vector / (np.linalg.norm(vector) or 1)
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return {"doc_id": cols["doc_id"], "lang_pred": langs, "score": scores}

    source = id_and_text(df, id_col, text_col)
    return map_slices(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    from strandloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = predict(docs, prototypes(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
