"""Position-frequency motifs: extraction, masks, scores over sequences, differential and older forms.

A motif is rows (motif_id, pos, a, t, g, c, norm, cnt), positions from 0. For scoring, a motif is one row of
arrays (``packed``), and scores are products over positions, by one of three modes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

MODES = ("degree", "eps", "strict")
_BASES = ("a", "t", "g", "c")


def extract(columns: DataFrame) -> DataFrame:
    """Motifs from column sums (cluster, pos, a, t, g, c, n_rows): from the first column filled by over half of the total, to the last filled by half or more."""
    norm = columns.withColumn("norm", F.col("a") + F.col("t") + F.col("g") + F.col("c")).withColumn("half", F.floor(F.col("n_rows") / 2))
    bounds = norm.groupBy("cluster").agg(F.min(F.when(F.col("norm") > F.col("half"), F.col("pos"))).alias("low"), F.max(F.when(F.col("norm") >= F.col("half"), F.col("pos"))).alias("high"))
    return norm.join(bounds, "cluster").where("pos between low and high").select(F.col("cluster").alias("motif_id"), (F.col("pos") - F.col("low")).alias("pos"), *_BASES, "norm", F.col("n_rows").alias("cnt"))


def mask_symbol() -> Column:
    """Upper case for a base over half, lower case over 1/2.5 or a third, else a question mark; the first such base."""
    out = F.lit("?")
    for limit, case in ((F.floor(F.col("cnt") / 3), str.lower), (F.col("cnt") / 2.5, str.lower), (F.floor(F.col("cnt") / 2), str.upper)):
        for b in reversed(_BASES):
            out = F.when(F.col(b) > limit, case(b)).otherwise(out)
    return out


def packed(motifs: DataFrame) -> DataFrame:
    """(motif_id, cnt, mask, freq, norm, norm_score, norm_degree): one row a motif, with the factors that make the best score 1."""
    rows = motifs.groupBy("motif_id").agg(F.max("cnt").alias("cnt"), F.array_sort(F.collect_list(F.struct("pos", mask_symbol().alias("s"), F.array(*_BASES).alias("f"), "norm"))).alias("p"))
    best = lambda p: F.array_max(p["f"]).cast("double")
    degree = lambda p: F.when(p["norm"] == F.col("cnt"), best(p)).otherwise(F.pow(best(p), p["norm"] / F.col("cnt")))
    return rows.select(
        "motif_id", "cnt",
        F.array_join(F.transform("p", lambda p: p["s"]), "").alias("mask"),
        F.transform("p", lambda p: p["f"]).alias("freq"), F.transform("p", lambda p: p["norm"]).alias("norm"),
        (1 / F.aggregate("p", F.lit(1.0), lambda s, p: s * best(p))).alias("norm_score"),
        (1 / F.aggregate("p", F.lit(1.0), lambda s, p: s * degree(p))).alias("norm_degree"),
    )


class Scorer:
    """A motif's score table: log factors by position and symbol (A, T, G, C, any)."""

    def __init__(self, freq, norm, cnt: int, mode: str):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        f = np.asarray(freq, dtype=np.float64).reshape(-1, 4)
        f = np.concatenate([f, f.min(axis=1, keepdims=True)], axis=1)
        top = f[:, :4].max(axis=1)
        if mode == "degree":
            power = np.asarray(norm, dtype=np.float64) / cnt
            f, top = np.where(f <= 0, 0.1, f) ** power[:, None], top**power
        elif mode == "eps":
            f = np.where(f == 0, 1.0, f)
        with np.errstate(divide="ignore"):
            self.table = np.log(f) - np.log(top)[:, None]
        self.length = len(f)

    def scores(self, codes: np.ndarray, inclusive: bool = False) -> np.ndarray:
        """Scores at each start; the last possible one only if ``inclusive``."""
        n = len(codes) - self.length + inclusive
        if n <= 0:
            return np.empty(0)
        total = np.zeros(n)
        for k in range(self.length):
            total += self.table[k][codes[k : k + n]]
        return np.exp(total)


_CODE = np.full(256, 4, dtype=np.uint8)
for _k, _b in enumerate(b"ATGC"):
    _CODE[_b] = _k
_COMPLEMENT = np.array([1, 0, 3, 2, 4], dtype=np.uint8)


def turned(seq: str) -> list[np.ndarray]:
    """Codes of the four orientations."""
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    return [codes, codes[::-1], _COMPLEMENT[codes], _COMPLEMENT[codes][::-1]]


def max_score(seq: str, scorers: list[Scorer], against: list[Scorer] | None = None, inclusive: bool = False, average: bool = True) -> float:
    """The greatest score over orientations and starts, at least 0; of a difference of two motif sets, moved to 0..1, if ``against``; 0 without motifs."""
    best = 0.0
    if not scorers or against == []:
        return best
    length = max(s.length for s in [*scorers, *(against or [])])
    for codes in turned(seq):
        n = len(codes) - length + inclusive
        if n <= 0:
            continue
        sides = []
        for side in [scorers] if against is None else [scorers, against]:
            mean, most = average and against is not None, np.zeros(n)
            for s in side:  # one motif's scores at a time; none is below 0
                made = s.scores(codes, inclusive)[:n]
                (np.add if mean else np.maximum)(most[: len(made)], made, out=most[: len(made)])
            sides.append(most / len(side) if mean else most)
        value = sides[0] if against is None else (sides[0] - sides[1] + 1) / 2
        best = max(best, float(value.max()))
    return best


def max_score_between(seq: str, scorer: Scorer, start: int, end: int) -> float:
    """The greatest score of the straight sequence at starts from ``start`` to below ``end`` (and below the last start), at least 0."""
    made = scorer.scores(turned(seq)[0])[max(start, 0) : max(end, 0)]
    return float(made.max()) if len(made) else 0.0


def scores_between(seqs: DataFrame, motifs: DataFrame, mode: str = "degree") -> DataFrame:
    """(frag_id, motif_id, score): ``max_score_between`` of rows (frag_id, seq, start, end) and every motif."""
    known = scorers(motifs, mode)
    kind = seqs.schema["frag_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for motif_id, s in known.items():
                every = zip(batch["seq"], batch["start"], batch["end"], strict=True)
                yield pd.DataFrame({"frag_id": batch["frag_id"], "motif_id": motif_id, "score": [max_score_between(x or "", s, a, b) for x, a, b in every]})

    return seqs.select("frag_id", "seq", "start", "end").mapInPandas(run, f"frag_id {kind}, motif_id {motifs.schema['motif_id'].dataType.simpleString()}, score double")


def scorers(motifs: DataFrame, mode: str = "degree") -> dict:
    """Scorers by motif id; one a cluster of words."""
    found = packed(motifs).select("motif_id", "freq", "norm", "cnt").toArrow()
    rows = (r for batch in found.to_batches(1000) for r in batch.to_pylist())
    return {r["motif_id"]: Scorer(r["freq"], r["norm"], r["cnt"], mode) for r in rows}


#: Symbols of sequences that are scored at once.
SYMBOLS = 1 << 18


def by_length(seqs: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places, codes of the four orientations, a row a sequence) of the sequences of each length, some at a time."""
    same: dict[int, list[int]] = {}
    for i, x in enumerate(seqs):
        same.setdefault(len(x), []).append(i)
    for length, every in same.items():
        step = max(1, SYMBOLS // max(length, 1))
        for low in range(0, len(every), step):
            at = every[low : low + step]
            codes = _CODE[np.frombuffer("".join(seqs[i] for i in at).encode("ascii", "replace"), dtype=np.uint8)].reshape(len(at), length)
            yield np.array(at), [codes, codes[:, ::-1], _COMPLEMENT[codes], _COMPLEMENT[codes][:, ::-1]]


def max_of_each(oriented: list[np.ndarray], scorer: Scorer, inclusive: bool = False) -> np.ndarray:
    """``max_score`` by one motif of many sequences of one length."""
    rows, length = oriented[0].shape
    best, n = np.zeros(rows), length - scorer.length + inclusive
    for codes in oriented if n > 0 else ():
        total = np.zeros((rows, n))
        for k in range(scorer.length):
            total += scorer.table[k][codes[:, k : k + n]]
        found = np.exp(total).max(axis=1)
        best = np.where(found > best, found, best)
    return best


def max_scores(seqs: DataFrame, motifs: DataFrame, mode: str = "degree", inclusive: bool = False) -> DataFrame:
    """(frag_id, motif_id, score) of every fragment and motif; fragments are read once, in Arrow batches, and those of one length are scored together."""
    known = scorers(motifs, mode)
    kind = seqs.schema["frag_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = list(by_length([x or "" for x in batch["seq"]]))
            for motif_id, s in known.items():
                score = np.zeros(len(batch))
                for at, oriented in groups:
                    score[at] = max_of_each(oriented, s, inclusive)
                yield pd.DataFrame({"frag_id": batch["frag_id"], "motif_id": motif_id, "score": score})

    return seqs.select("frag_id", "seq").mapInPandas(run, f"frag_id {kind}, motif_id {motifs.schema['motif_id'].dataType.simpleString()}, score double")


def diff_scores(seqs: DataFrame, positive: DataFrame, negative: DataFrame, mode: str = "degree", average: bool = True) -> DataFrame:
    """(frag_id, score) of the positive motifs against the negative ones."""
    pos, neg = list(scorers(positive, mode).values()), list(scorers(negative, mode).values())
    score = pandas_udf(lambda column: pd.Series([max_score(x or "", pos, neg, average=average) for x in column]), "double")
    return seqs.select("frag_id", score("seq").alias("score"))


def scores_at(words: DataFrame, motifs: DataFrame, mode: str) -> DataFrame:
    """(motif_id, word, score) of words of the motif's length, straight, in Catalyst expressions."""
    value = {
        "eps": "case when c = 0 then 1D else cast(c as double) end",
        "strict": "cast(c as double)",
        "degree": "case when norm[i] = cnt then greatest(cast(c as double), if(c <= 0, 0.1D, 0D)) else pow(if(c <= 0, 0.1D, cast(c as double)), norm[i] / cast(cnt as double)) end",
    }[mode]
    c = "case when locate(substr(word, i + 1, 1), 'ATGC') > 0 then freq[i][locate(substr(word, i + 1, 1), 'ATGC') - 1] else array_min(freq[i]) end"
    product = f"aggregate(sequence(0, size(freq) - 1), 1D, (s, i) -> s * {value.replace('c = 0', f'({c}) = 0').replace('cast(c as', f'cast(({c}) as').replace('c <= 0', f'({c}) <= 0')})"
    scale = "norm_degree" if mode == "degree" else "norm_score"
    return words.crossJoin(F.broadcast(packed(motifs))).where("length(word) = size(freq)").select("motif_id", "word", (F.expr(product) * F.col(scale)).alias("score"))


def strict_scores(words: DataFrame, pattern: str) -> DataFrame:
    """(word, score): the greatest share, over the pattern's orientations, of equal or unknown symbols. Lengths must be equal."""
    from strandloom.functions import sequence as S

    def share(d: int) -> Column:
        p = S.oriented(F.lit(pattern), d)
        same = F.aggregate(F.sequence(F.lit(1), F.lit(len(pattern))), F.lit(0), lambda s, i: s + F.when((F.substr(F.col("word"), i, F.lit(1)) == F.substr(p, i, F.lit(1))) | (F.substr(F.col("word"), i, F.lit(1)) == "N") | (F.substr(p, i, F.lit(1)) == "N"), 1).otherwise(0))
        return same / len(pattern)

    checked = F.when(F.length("word") == len(pattern), F.col("word")).otherwise(F.raise_error(F.lit(f"not of length {len(pattern)}")))
    return words.select(checked.alias("word")).select("word", F.greatest(*[share(d) for d in range(4)]).alias("score"))


def probability_scores(words: DataFrame, motifs: DataFrame) -> DataFrame:
    """(motif_id, word, score): the greatest product over orientations of the counts' shares of each column's total; unknown symbols count 0.1."""
    from strandloom.functions import sequence as S

    def product(d: int) -> Column:
        at = F.element_at(S.orientations("word"), d + 1)
        return F.aggregate(F.sequence(F.lit(0), F.size("freq") - 1), F.lit(1.0), lambda s, i: s * F.coalesce(F.get(F.get(F.col("freq"), i), _code(at, i)).cast("double"), F.lit(0.1)) / F.get(F.col("norm"), i))

    return words.crossJoin(F.broadcast(packed(motifs))).where("length(word) = size(freq)").select("motif_id", "word", F.greatest(*[product(d) for d in range(4)]).alias("score"))


def _code(seq: Column, i: Column) -> Column:
    """The symbol's code at a place, null for an unknown one."""
    return F.translate(F.translate(F.substr(seq, i + 1, F.lit(1)), "N", ""), "ATGC", "0123").try_cast("int")


def probability_text(motifs: DataFrame) -> DataFrame:
    """(motif_id, text): a symbol for each column. The runner-up is the largest value before the maximum was met."""
    total, values = F.col("norm"), [F.col(b) for b in _BASES]
    most = F.greatest(*values)
    first = F.when(values[0] == most, 0).when(values[1] == most, 1).when(values[2] == most, 2).otherwise(3)
    before = F.lit(None).cast("bigint")
    for k in (1, 2, 3):
        run = F.greatest(*values[:k]) if k > 1 else values[0]
        before = F.when(first == k, F.when(run > 0, run)).otherwise(before)
    letter = F.substr(F.lit("ATGC"), first + 1, F.lit(1))
    upper = before.isNull() | (most * 2 > total) | (most > before * 2)
    symbol = F.when((total == 0) | (most == 0), "*").when(upper, letter).when(most * 3 > total, F.lower(letter)).otherwise("?")
    return motifs.groupBy("motif_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("text"))


def cross_test(rows: DataFrame, motifs: DataFrame, mode: str = "degree") -> DataFrame:
    """(motif_id, cluster, avg_score, max_score): each motif against the aligned rows of each cluster."""
    plain = rows.select(F.struct("cluster", "id").alias("frag_id"), F.translate("row", " ", "N").alias("seq"))
    scored = max_scores(plain, motifs, mode)
    return scored.groupBy("motif_id", F.col("frag_id.cluster").alias("cluster")).agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))
