"""Quality rules: a table of thresholds compiled into one projection of DataFrame functions.

A word is a run of anything but a space or the characters 9 to 13. The measures of a text
(lengths, symbol, stop-word and line ratios, repeats) are columns; each row of ``RULES`` is a
measure with a lower and an upper bound, and a text is kept if it breaks none. No user function
is involved.

Repeated five-word windows are found exactly: the windows' hashes are compared first, and only
for a text in which two hashes are equal are the windows themselves sorted and compared.

Edge cases: a null or empty text has no words, so it fails the base rule (fewer than ten words)
and ratios over nothing are 0; a value equal to a bound passes; repeated rows are each judged; texts
may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, table

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Common words of the four languages; a text of running prose has some of them.
STOP_WORDS = (
    "the of and to a in is that it was for on are as with at be this from or by "
    "der die das und ist in den von zu mit für auf nicht ein eine als auch an "
    "le la les de des et un une du en que qui dans pour par sur est au aux "
    "el los las y en un una por con para del se no su lo que"
).split()

#: (measure, least, most); None: no bound on that side.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.30),
    ("repeat_word_ratio", None, 0.20),
)


def _ratio(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df`` with every measure that a rule can bound."""
    words = F.split(F.expr(f"trim(BOTH '{_sql(SPACES)}' FROM text)"), f"[{SPACES}]+")
    split = id_and_text(df, id_col, text_col).select("doc_id", "text", F.when(F.length(F.translate("text", SPACES, "")) == 0, F.array().cast("array<string>")).otherwise(words).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(0), n - WINDOW)
    word = lambda i: F.get("words", i)
    hashes = F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_own_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        hashes.alias("hashes"),
    )
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    sorted_ = counted.withColumn("windows", F.when(suspect, windows))
    at = lambda j: F.get("windows", j)["w"]
    twice = F.array_sort(
        F.transform(
            F.filter("windows", lambda x, j: F.coalesce(x["w"] == at(j - 1), F.lit(False)) | F.coalesce(x["w"] == at(j + 1), F.lit(False))),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    made = sorted_.withColumn("twice", F.when(F.col("windows").isNotNull(), twice)).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return made.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("n_own_lines")).alias("n_dup_lines"),
        "n_repeat_words",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        F.when(F.col("n_lines") > 0, (F.col("n_lines") - F.col("n_own_lines")) / F.col("n_lines")).otherwise(F.lit(0.0)).alias("dup_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def _sql(s: str) -> str:
    return s.replace("\x0b", "\\u000B").replace("\f", "\\u000C").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def broken(rules=RULES) -> Column:
    """The names of the rules that a row of measures breaks."""
    checks = []
    for measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < least)
        if most is not None:
            bad = bad | (F.col(measure) > most)
        checks.append(F.when(bad, F.lit(measure)))
    return F.array_compact(F.array(*checks))


def judge(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``broken`` (names of broken rules), ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(df, id_col, text_col).withColumn("broken", broken(rules)).withColumn("base_failed", base).withColumn("kept", ~base & (F.size("broken") == 0))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql(rules=RULES) -> str:
    kept = []
    for measure, least, most in rules:
        kept += [f"{measure} >= {least}"] if least is not None else []
        kept += [f"{measure} <= {most}"] if most is not None else []
    return " AND ".join(kept)


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS lines FROM d
), x AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM s)
), r AS (
  SELECT doc_id, sum(least(5, i - before)) AS n FROM (
    SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5) AS before FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains(['{"', '".join(dict.fromkeys(STOP_WORDS))}'], lower(w)))) AS n_stop_words
  FROM s LEFT JOIN r USING (doc_id)
), q AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
    coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM q
"""
