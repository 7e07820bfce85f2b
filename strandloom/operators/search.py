"""Genetic search for words that cover positive fragments rather than negative ones.

The population is small; the fragments are not. Words of the search's length are counted once for each side. There are 4 to the length of
them at most: up to ``LOOKUP`` their scores are found in one job and looked up from then on; for longer words each generation's candidates
meet the counts in a join.
"""

from __future__ import annotations

import math
import random

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import scores as I
from strandloom.functions import sequence as S
from strandloom.operators.words import counted


_CODES = str.maketrans(S.SYMBOLS, "0123")


def degenerate(word: Column) -> Column:
    """Over two thirds of one base, or only of G and C, or only of A and T."""
    return (S.most_of_a_base(word) > F.floor(2 * F.length(word) / 3)) | (F.length(F.translate(word, "GC", "")) == 0) | (F.length(F.translate(word, "AT", "")) == 0)


def is_degenerate(word: str) -> bool:
    most = max(word.count(b) for b in S.SYMBOLS)
    return most > 2 * len(word) // 3 or set(word) <= set("GC") or set(word) <= set("AT")


def turned(words: DataFrame) -> DataFrame:
    """Each word with its four orientations; a palindrome's come more than once."""
    return words.select("word", F.explode(S.orientations("word")).alias("form"))


def fitness(words: DataFrame, pos_counts: DataFrame, neg_counts: DataFrame, total_p: int, total_n: int) -> DataFrame:
    """(word, p, n, total_p, total_n, inf): occurrences of the four orientations on either side, and their information."""
    p = pos_counts.select(F.col("word").alias("form"), F.col("cnt").alias("p"))
    n = neg_counts.select(F.col("word").alias("form"), F.col("cnt").alias("n"))
    found = turned(words.select("word").distinct()).join(p, "form", "left").join(n, "form", "left").groupBy("word").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("p", "n")])
    whole = found.withColumn("total_p", F.lit(total_p).cast("bigint")).withColumn("total_n", F.lit(total_n).cast("bigint"))
    args = [F.col(c) for c in ("p", "n", "total_p", "total_n")]
    return whole.withColumn("inf", I.informativity(*args))


def totals(seqs: DataFrame, offset: int = -1, factor: int = 10) -> int:
    """The assumed number of rows on a side: fragments (less one) times ten."""
    return max(0, (seqs.count() + offset) * factor)


def select(scored: DataFrame, size: int) -> DataFrame:
    """The ``size`` most informative distinct words; ties by the word's code, the greater first."""
    return scored.dropDuplicates(["word"]).orderBy(F.col("inf").desc(), S.codes("word").desc()).limit(size)


def unseen(words: DataFrame, seen: DataFrame) -> DataFrame:
    return words.join(seen.select("word"), "word", "left_anti")


def mutated(word: str, count: int, rnd: random.Random, positions: str = "first") -> str:
    """``count`` (at least 1) places changed to another symbol: the first ones, or any with ``positions='any'``."""
    places = rnd.sample(range(len(word)), min(len(word), max(count, 1))) if positions == "any" else range(min(len(word), max(count, 1)))
    out = list(word)
    for k in places:
        out[k] = rnd.choice([b for b in S.SYMBOLS if b != out[k]])
    return "".join(out)


def mutated_by_order(word: str, order: float, rnd: random.Random, positions: str = "first") -> str:
    return mutated(word, max(round(order * len(word)), 1), rnd, positions)


def crossed(a: str, b: str, rnd: random.Random) -> str:
    return "".join(x if rnd.random() < 0.5 else y for x, y in zip(a, b, strict=True))


#: Words of a length whose scores the driver may hold: 4 to the power of 10.
LOOKUP = 1 << 20


class Search:
    """The loop: grow candidates from the population, score them in one job, keep the best."""

    def __init__(self, pos: DataFrame, neg: DataFrame, pop_size: int = 25, length: int = 10, seed: int = 1):
        self.spark: SparkSession = pos.sparkSession
        self.pop_size, self.length, self.rnd = pop_size, length, random.Random(seed)
        self.total_p, self.total_n = totals(pos), totals(neg)
        self.pos_counts, self.neg_counts = counted(pos, length), counted(neg, length)
        self.known: dict[str, tuple] | None = None
        if 4**length <= LOOKUP:
            met = self.pos_counts.select("word").union(self.neg_counts.select("word")).select(F.explode(S.orientations("word")).alias("word"))
            self.known = {r.word: tuple(r)[1:] for r in fitness(met, self.pos_counts, self.neg_counts, self.total_p, self.total_n).collect()}  # 4**length rows at most
        else:
            self.pos_counts, self.neg_counts = self.pos_counts.persist(StorageLevel.DISK_ONLY), self.neg_counts.persist(StorageLevel.DISK_ONLY)
        self.seen: set[str] = set()
        self.scores: dict[str, tuple] = {}
        self.population: list[str] = []
        self.best: str | None = None
        self.finished = False

    def _failed(self, word: str) -> bool:
        known = word in self.seen
        self.seen.add(word)
        return known or is_degenerate(word)

    def _random(self) -> str:
        return "".join(self.rnd.choices(S.SYMBOLS, k=self.length))

    def _grown(self) -> list[str]:
        if not self.population:
            return [w for w in (self._random() for _ in range(self.pop_size)) if not self._failed(w)]
        new, failed = [], 0
        while len(new) < self.pop_size and failed <= 500 * max(len(new), 1) + 500 * self.pop_size:
            order = list(range(len(self.population)))
            self.rnd.shuffle(order)
            made = []
            for i in order:
                word = self.population[i]
                if self.rnd.random() < 0.5 or len(self.population) == 1:
                    made.append(mutated(word, self.rnd.randrange(max(1, self.length // 2)) + 1, self.rnd))
                else:
                    j = self.rnd.randrange(1, len(self.population)) if i == 0 else self.rnd.randrange(i)
                    made.append(crossed(word, self.population[j], self.rnd))
            made += [self._random() for _ in range(self.pop_size // 10)]
            for word in made:
                if self._failed(word):
                    failed += 1
                else:
                    new.append(word)
        self.finished = failed > 500 * len(new)
        return new

    def _order(self, word: str) -> tuple:
        info = self.scores[word][-1]
        return -math.inf if info is None else info, word.translate(_CODES)

    def iterate(self) -> bool:
        """One generation; whether the best word improved."""
        fresh = sorted(set(self._grown()))
        if self.known is not None:
            none = (0, 0, self.total_p, self.total_n, -1.0)  # a word that is nowhere
            self.scores |= {w: self.known.get(w, none) for w in fresh}
        elif fresh:
            words = self.spark.createDataFrame([(w,) for w in fresh], "word string")
            for r in fitness(words, self.pos_counts, self.neg_counts, self.total_p, self.total_n).collect():  # a population
                self.scores[r.word] = (r.p, r.n, r.total_p, r.total_n, r.inf)
        pool = {*fresh, *([self.best] if self.best else [])}
        self.population = sorted(pool, key=self._order, reverse=True)[: self.pop_size]
        better = bool(self.population) and (self.best is None or self._order(self.population[0]) > self._order(self.best))
        if better:
            self.best = self.population[0]
        return better

    def result(self) -> DataFrame:
        return self.spark.createDataFrame([(w, *self.scores[w]) for w in self.population], "word string, p long, n long, total_p long, total_n long, inf double")


    def close(self) -> None:
        self.pos_counts.unpersist()
        self.neg_counts.unpersist()


def search(pos: DataFrame, neg: DataFrame, generations: int | None = None, **parameters) -> DataFrame:
    """The last population of a search that runs until it is finished: until new words get so rare that 500 tries find fewer than one. ``generations`` ends it before."""
    run = Search(pos, neg, **parameters)
    while not run.finished and generations != 0:
        run.iterate()
        generations = None if generations is None else generations - 1
    run.close()
    return run.result()
