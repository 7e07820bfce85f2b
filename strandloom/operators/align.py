"""Pairwise ungapped alignment in four orientations, multiple alignment and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def _shifted(a: Column, b: Column, direction: int) -> Column:
    """Every relative shift of b (oriented) against a, with its number of equal symbols."""
    turned = S.oriented(b, direction)

    def at(s: Column) -> Column:
        skip_a, skip_b = F.greatest(F.length(a) - s - 1, F.lit(0)), F.greatest(s + 1 - F.length(a), F.lit(0))
        n = F.least(F.length(a) - skip_a, F.length(b) - skip_b)
        marks = F.array_join(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substr(a, skip_a + i, F.lit(1)) == F.substr(turned, skip_b + i, F.lit(1)), F.substr(a, skip_a + i, F.lit(1))).otherwise("?")), ""
        )
        return F.struct(F.length(F.translate(marks, "?", "")).alias("weight"), F.lit(-direction).alias("d"), (-s).alias("s"), marks.alias("marks"), skip_a.alias("skip_a"), skip_b.alias("skip_b"))

    return F.transform(F.sequence(F.lit(0), F.length(a) + F.length(b) - 2), at)


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with (weight, mask, direction, shift1, shift2) of the best alignment of two of its columns: the most equal
    symbols; then the first direction, then the least shift. The shifts skip what the mask's trimming takes off.

    The best candidate goes through a generator, so that the optimizer cannot copy the search to each field."""
    every = F.concat(*[_shifted(F.col(a), F.col(b), d) for d in range(4)])
    found = pairs.select(*pairs.columns, F.inline(F.array(F.array_max(every))))
    lead = F.length("marks") - F.length(F.ltrim("marks", F.lit("?")))
    return found.select(
        *pairs.columns, F.col("weight").cast("bigint").alias("weight"), F.trim("marks", F.lit("?")).alias("mask"), (-F.col("d")).cast("bigint").alias("direction"),
        (F.col("skip_a") + lead).cast("bigint").alias("shift1"), (F.col("skip_b") + lead).cast("bigint").alias("shift2"),
    )


def all_pairs(words: DataFrame) -> DataFrame:
    """(id1, id2, weight, mask, direction, shift1, shift2) for id1 > id2.

    All pairs of a set of words are this operator's result; ``words`` is one cluster's or one run's words."""
    a = words.select(F.col("id").cast("bigint").alias("id1"), F.col("word").alias("a"))
    b = words.select(F.col("id").cast("bigint").alias("id2"), F.col("word").alias("b"))
    return aligned(a.join(F.broadcast(b), F.col("id1") > F.col("id2")), "a", "b").drop("a", "b")


def weight_matrix(words: DataFrame) -> DataFrame:
    """(i, j, weight), both ways, 0 on the diagonal."""
    pairs = all_pairs(words).select(F.col("id1").alias("i"), F.col("id2").alias("j"), "weight")
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    return both.unionByName(words.select(F.col("id").cast("bigint").alias("i"), F.col("id").cast("bigint").alias("j"), F.lit(0).cast("bigint").alias("weight")))


def multiple(words: DataFrame, align_to: str = "first", sums: DataFrame | None = None) -> DataFrame:
    """(cluster, id, cnt, direction, shift, row): rows of each cluster shifted against each other, padded on the left with blanks.

    ``words`` has (cluster, id, word, cnt). The word of the greatest summed weight (the first of such) is the base: straight, shift
    0. The others are aligned to the cluster's first word, or with ``align_to='base'`` to the base. ``sums`` (cluster, id, total) are the
    words' summed weights within their clusters, if they are known."""
    sums = _sums(words) if sums is None else sums
    totals = words.join(sums, ["cluster", "id"], "left").select("cluster", "id", "word", F.coalesce("total", F.lit(0)).alias("total"))
    heads = totals.groupBy("cluster").agg(F.max_by("id", F.struct("total", -F.col("id"))).alias("base_id"), F.min_by("word", "id").alias("first"), F.max_by("word", F.struct("total", -F.col("id"))).alias("base"))
    # Alignments take long and words are few: dealt over all cores, which adaptive execution would not do by their size.
    joined = words.join(heads.withColumn("parent", F.col(align_to)), "cluster").repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "id")
    placed = aligned(joined.select("cluster", "id", "word", "cnt", (F.col("id") == F.col("base_id")).alias("is_base"), "parent"), "parent", "word")
    moved = placed.select(
        "cluster", "id", "word", "cnt",
        F.when(F.col("is_base"), 0).otherwise(F.col("direction")).cast("bigint").alias("direction"),
        F.when(F.col("is_base"), 0).otherwise(F.col("shift1") - F.col("shift2")).cast("bigint").alias("raw"),
    )
    shift = F.col("raw") - F.min("raw").over(Window.partitionBy("cluster"))
    turned = F.element_at(S.orientations("word"), (F.col("direction") + 1).cast("int"))
    return moved.withColumn("shift", shift).select("cluster", "id", "cnt", "direction", "shift", F.concat(F.repeat(F.lit(" "), F.col("shift").cast("int")), turned).alias("row"))


def _sums(words: DataFrame) -> DataFrame:
    a = words.select("cluster", F.col("id").alias("id1"), F.col("word").alias("a"))
    b = words.select("cluster", F.col("id").alias("id2"), F.col("word").alias("b"))
    pairs = aligned(a.join(b, "cluster").where("id1 > id2"), "a", "b").select("cluster", "id1", "id2", "weight")
    both = pairs.unionByName(pairs.select("cluster", F.col("id2").alias("id1"), F.col("id1").alias("id2"), "weight"))
    return both.groupBy("cluster", F.col("id1").alias("id")).agg(F.sum("weight").alias("total"))


def columns(rows: DataFrame, factor: str | None = None) -> DataFrame:
    """(cluster, pos, a, t, g, c, n_rows): counts (or sums of ``factor``) of each base in each column from 0."""
    weight = F.col(factor).cast("bigint") if factor else F.lit(1).cast("bigint")
    cells = rows.select("cluster", weight.alias("f"), F.posexplode(F.split("row", "")).alias("pos", "base"))
    sums = cells.groupBy("cluster", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("f"))), F.lit(0)).alias(b.lower()) for b in S.SYMBOLS])
    totals = rows.groupBy("cluster").agg(F.sum(weight).alias("n_rows"))
    return sums.join(totals, "cluster").select("cluster", F.col("pos").cast("bigint").alias("pos"), "a", "t", "g", "c", "n_rows")


def best_symbol(total: Column) -> Column:
    """The first base with half of the total or more, else the first with a third or more in lower case, else a blank."""
    half, third = F.floor(total / 2), F.floor(total / 3)
    out = F.lit(" ")
    for b in reversed(S.SYMBOLS):
        out = F.when(F.col(b.lower()) >= third, b.lower()).otherwise(out)
    for b in reversed(S.SYMBOLS):
        out = F.when(F.col(b.lower()) >= half, b).otherwise(out)
    return out


def consensus(rows: DataFrame) -> DataFrame:
    """(cluster, mask): a symbol for each column that over a third of the rows fill."""
    total = F.col("a") + F.col("t") + F.col("g") + F.col("c")
    symbol = F.when(total > F.floor(F.col("n_rows") / 3), best_symbol(total)).otherwise(" ")
    return columns(rows).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("mask"))


def row_weights(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """(cluster, id, weight): how many of a row's symbols equal the consensus."""
    same = F.expr("size(filter(sequence(1, greatest(length(row), 1)), i -> substr(row, i, 1) <> ' ' and substr(row, i, 1) = substr(mask, i, 1)))")
    return rows.join(masks, "cluster").select("cluster", "id", same.cast("bigint").alias("weight"))
