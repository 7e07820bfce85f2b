"""DuckDB text of the derived inputs, as named parts of a WITH list."""

from __future__ import annotations

_ORIENT = "CASE d WHEN 0 THEN {s} WHEN 1 THEN reverse({s}) WHEN 2 THEN translate({s}, 'ATGC', 'TACG') ELSE reverse(translate({s}, 'ATGC', 'TACG')) END"


def orient(s: str) -> str:
    return _ORIENT.format(s=s)


def most_of_a_base(w: str) -> str:
    return "greatest(" + ", ".join(f"len({w}) - len(replace({w}, '{b}', ''))" for b in "ATGC") + ")"


def is_complex(w: str) -> str:
    return f"(NOT starts_with({w}, 'CCC') AND {most_of_a_base(w)} < 2 * len({w}) // 3)"


def kmers(source: str, k: int, columns: str = "") -> str:
    return f"SELECT {columns}substr(seq, i, {k}) AS word, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(seq) - {k} + 2)) AS i FROM {source})"


def ln_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


INFORMATION = (
    "CASE WHEN p + n = 0 THEN -1.0 WHEN n / (p + n) > 0.5 THEN -(n / (p + n)) WHEN p > total_p OR n > total_n THEN NULL WHEN p * total_n < total_p * n THEN 0.0 ELSE "
    + f"{ln_choose('(total_p + total_n)', '(p + n)')} - {ln_choose('total_p', 'p')} - {ln_choose('total_n', 'n')} END"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "seqs": ((), "SELECT doc_id AS frag_id, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM documents"),
    "pos_seqs": (("seqs",), "SELECT frag_id, seq FROM seqs JOIN labels ON labels.doc_id = frag_id WHERE quality = 1"),
    "neg_seqs": (("seqs",), "SELECT frag_id, seq FROM seqs JOIN labels ON labels.doc_id = frag_id WHERE quality = 0"),
    "peaks": (
        (),
        "SELECT event_id, 'chr' || (user_id % 22 + 1) AS chrom, dense_rank() OVER (ORDER BY event_type) - 1 AS cell_id, "
        "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000) // 20 AS start_pos, "
        "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000) // 20 + 100 + (event_id * 7919) % 400 AS end_pos, "
        "value * 10 AS value1, value AS value2 FROM events",
    ),
    "clumps": (
        ("peaks",),
        "SELECT chrom, min(start_pos) AS start_min, max(end_pos) AS end_max, min(start_pos) AS start_pos, max(end_pos) AS end_pos, "
        "count(*) AS cells, avg(value1) AS mean FROM peaks GROUP BY chrom, start_pos // 500",
    ),
    "manifest": ((), "SELECT p_partkey AS line_no, p_name || chr(9) || 'brand=' || p_brand || '; type=' || p_type || '; size=' || p_size AS line FROM part"),
    "word_counts": (("pos_seqs",), f"SELECT word, count(*) AS cnt FROM ({kmers('pos_seqs', 10)}) GROUP BY word"),
    "words": (
        ("word_counts",),
        f"SELECT row_number() OVER (ORDER BY cnt DESC, word) - 1 AS id, word, cnt FROM (SELECT * FROM word_counts WHERE {is_complex('word')} ORDER BY cnt DESC, word LIMIT 40)",
    ),
    "every_pair": (("words",), "SELECT a.id AS i, b.id AS j, a.word AS a, b.word AS b FROM words a, words b"),
    "candidates": (
        ("every_pair",),
        f"SELECT i, j, a, d, s, greatest(0, len(a) - s - 1) AS sa, greatest(0, s + 1 - len(a)) AS sb, {orient('b')} AS b "
        "FROM (SELECT *, unnest(range(0, len(a) + len(b) - 1)) AS s FROM (SELECT *, unnest(range(0, 4)) AS d FROM every_pair))",
    ),
    "marked": (
        ("candidates",),
        "SELECT *, array_to_string(list_transform(range(1, least(len(a) - sa, len(b) - sb) + 1), "
        "lambda k: CASE WHEN substr(a, sa + k, 1) = substr(b, sb + k, 1) THEN substr(a, sa + k, 1) ELSE '?' END), '') AS marks FROM candidates",
    ),
    "aligned": (
        ("marked",),
        "SELECT i, j, len(replace(marks, '?', '')) AS weight, trim(marks, '?') AS mask, d AS direction, "
        "sa + len(marks) - len(ltrim(marks, '?')) AS shift1, sb + len(marks) - len(ltrim(marks, '?')) AS shift2 "
        "FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY len(replace(marks, '?', '')) DESC, d, s) AS r FROM marked) WHERE r = 1",
    ),
    "base": (
        ("aligned",),
        "SELECT arg_max(i, total * 1000 - i) AS base_id FROM "
        "(SELECT w.id AS i, coalesce(sum(CASE WHEN a.i > a.j THEN a.weight ELSE z.weight END), 0) AS total FROM words w "
        "LEFT JOIN aligned a ON a.i = w.id AND a.j <> w.id LEFT JOIN aligned z ON z.i = a.j AND z.j = a.i GROUP BY w.id)",
    ),
    "multi": (
        ("aligned", "base"),
        "SELECT id, cnt, direction, raw - min(raw) OVER () AS shift, word FROM (SELECT w.id, w.cnt, w.word, "
        "CASE WHEN w.id = base_id THEN 0 ELSE a.direction END AS direction, CASE WHEN w.id = base_id THEN 0 ELSE a.shift1 - a.shift2 END AS raw "
        "FROM words w JOIN aligned a ON a.i = 0 AND a.j = w.id, base)",
    ),
    "multi_rows": (("multi",), f"SELECT id, cnt, d AS direction, shift, repeat(' ', CAST(shift AS BIGINT)) || {orient('word')} AS row FROM (SELECT *, direction AS d FROM multi)"),
    "ragged": (("words",), "SELECT id % 2 AS cluster, id, cnt, CASE WHEN id % 6 < 2 THEN substr(word, 1, 9) ELSE word END AS row FROM words"),
    "pfm": (
        ("ragged",),
        "SELECT cluster AS motif_id, k - 1 AS pos, "
        + ", ".join(f"sum(CASE WHEN substr(row, k, 1) = '{b.upper()}' THEN cnt ELSE 0 END) AS {b}" for b in "atgc")
        + ", sum(CASE WHEN substr(row, k, 1) <> '' THEN cnt ELSE 0 END) AS norm, sum(cnt) AS cnt FROM ragged, range(1, 11) t(k) GROUP BY cluster, k",
    ),
    "pfm_long": (("pfm",), " UNION ALL ".join(f"SELECT motif_id, pos, '{b.upper()}' AS base, {b} AS v, greatest(a, t, g, c) AS top, norm, cnt FROM pfm" for b in "atgc")),
    "edges": (("aligned",), "SELECT i, j, weight - 3 AS w FROM aligned WHERE i > j UNION ALL SELECT id, id, 0 FROM words"),
    "both_ways": (("edges",), "SELECT i, j, w FROM edges UNION ALL SELECT j, i, w FROM edges WHERE i <> j"),
    "shares": (
        ("pos_seqs", "neg_seqs"),
        "SELECT base AS motif_id, side, (len(seq) - len(replace(seq, base, ''))) / len(seq) AS score FROM "
        "(SELECT 'peak' AS side, seq FROM pos_seqs UNION ALL SELECT 'noise', seq FROM neg_seqs), (VALUES ('A'), ('T'), ('G'), ('C')) b(base) WHERE len(seq) > 0",
    ),
    "curve": (
        ("shares",),
        "SELECT motif_id, i, i / 200.0::DOUBLE AS thr, 100.0::DOUBLE * count(*) FILTER (WHERE side = 'noise' AND score >= i / 200.0::DOUBLE) / count(*) FILTER (WHERE side = 'noise') AS x, "
        "100.0::DOUBLE * count(*) FILTER (WHERE side = 'peak' AND score >= i / 200.0::DOUBLE) / count(*) FILTER (WHERE side = 'peak') AS y FROM shares, range(0, 201) t(i) GROUP BY motif_id, i",
    ),
    "areas": (
        ("curve",),
        "SELECT motif_id, (sum((x - lx) * (y + ly) / 2) + max(CASE WHEN i = 0 THEN CASE WHEN x < 100 THEN (100 - x) * (100 + y) / 2 ELSE 0 END END)) / 10000 AS auc FROM "
        "(SELECT *, coalesce(lag(x) OVER w, 0) AS lx, coalesce(lag(y) OVER w, 0) AS ly FROM curve WINDOW w AS (PARTITION BY motif_id ORDER BY i DESC)) GROUP BY motif_id",
    ),
    "totals": (("pos_seqs", "neg_seqs"), "SELECT (SELECT (count(*) - 1) * 10 FROM pos_seqs) AS total_p, (SELECT (count(*) - 1) * 10 FROM neg_seqs) AS total_n"),
    "pos_nine": (("pos_seqs",), f"SELECT word, count(*) AS cnt FROM ({kmers('pos_seqs', 9)}) GROUP BY word"),
    "neg_nine": (("neg_seqs",), f"SELECT word, count(*) AS cnt FROM ({kmers('neg_seqs', 9)}) GROUP BY word"),
    "fit": (
        ("pos_nine", "neg_nine", "totals"),
        "SELECT word, p, n, total_p, total_n, " + INFORMATION + " AS inf FROM (SELECT q.word, CAST(coalesce(sum(p.cnt), 0) AS BIGINT) AS p, CAST(coalesce(sum(g.cnt), 0) AS BIGINT) AS n "
        f"FROM (SELECT word, {orient('word')} AS form FROM (SELECT word, unnest(range(0, 4)) AS d FROM pos_nine)) q LEFT JOIN pos_nine p ON p.word = form LEFT JOIN neg_nine g ON g.word = form GROUP BY q.word), totals",
    ),
}


def with_views(body: str, *names: str) -> str:
    """The query with the views that it needs, in order of dependence."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + " " + body
