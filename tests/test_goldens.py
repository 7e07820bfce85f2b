"""Hand-made cases and brute-force restatements of the engine's own operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import human, scores
from strandloom.functions import sequence as S
from strandloom.operators import align, cluster, evaluate, intervals, motif, search, slices
from strandloom.operators import words as W
from strandloom.sources import files, views


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def dna(rnd, n):
    return "".join(rnd.choice("ATGC") for _ in range(n))


TURN = {"A": "T", "T": "A", "G": "C", "C": "G"}


def turned(w):
    c = "".join(TURN[x] for x in w)
    return [w, w[::-1], c, c[::-1]]


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("ATTGCA", "GTTGC", (4, "TTGC", 0, 1, 1)),
        ("ATGC", "CGTA", (4, "ATGC", 1, 0, 0)),
        ("AATTGG", "CCAATT", (6, "AATTGG", 3, 0, 0)),
        ("AAAA", "CCCC", (0, "", 0, 4, 1)),
        ("ATGCA", "GGG", (1, "G", 0, 2, 0)),
    ],
)
def test_pairwise_alignment(spark, a, b, want):
    got = align.aligned(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()
    assert tuple(got)[2:] == want


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(dna(rnd, rnd.randint(1, 9)), dna(rnd, rnd.randint(1, 9))) for _ in range(60)]
    for a, b, weight, _, direction, shift1, shift2 in align.aligned(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect():
        best = (-1,)
        for d, t in enumerate(turned(b)):
            for s in range(len(a) + len(b) - 1):
                sa, sb = max(0, len(a) - s - 1), max(0, s + 1 - len(a))
                w = sum(x == y for x, y in zip(a[sa:], t[sb:], strict=False))
                if w > best[0]:
                    best = (w, d, sa - sb)
        assert (weight, direction, shift1 - shift2) == best


@pytest.mark.parametrize(
    "a,b,want", [((0, 100), (100, 200), 1), ((100, 200), (0, 100), -1), ((0, 100), (10, 90), 0), ((0, 100), (19, 130), 0), ((0, 100), (20, 130), 1), ((20, 130), (0, 100), -1), ((5, 15), (0, 12), -1)]
)
def test_merge_status(spark, a, b, want):
    got = one(spark, intervals.merge_status(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])))
    assert got == want == intervals._status(("c", *a), ("c", *b))


def peak(start, end, cell, value=1.0):
    return ("chr1", start, end, start, start, end, end, [cell], [value], [value])


def test_merge_of_flows():
    a, b = [peak(0, 100, 0), peak(500, 600, 0)], [peak(10, 90, 1), peak(200, 300, 1), peak(700, 800, 1)]
    out = list(intervals.merge_flows(iter(a), iter(b)))
    assert [(r[1], r[2], r[7]) for r in out] == [(5, 95, [0, 1]), (200, 300, [1]), (500, 600, [0]), (700, 800, [1])]
    tail = list(intervals.merge_flows(iter(a[:1]), iter(b), emulate_tail_dup=True))
    assert [(r[1], r[7]) for r in tail] == [(5, [0, 1]), (10, [1]), (200, [1]), (700, [1])]


def random_peaks(rnd, n, reach, cells=4):
    return [(i, f"chr{rnd.choice([1, 2, 10])}", rnd.randrange(cells), s, s + rnd.randint(20, 200), rnd.random() * 400, 1.0) for i in range(n) for s in [rnd.randrange(reach)]]


PEAKS = "event_id long, chrom string, cell_id int, start_pos long, end_pos long, value1 double, value2 double"


def plain_tournament(rows, n):
    """The tournament over whole flows in lists, chromosome by chromosome, by the definition of a merge."""

    def status(a, b):
        if a["s"] >= b["e"]:
            return -1
        if b["s"] >= a["e"]:
            return 1
        if b["s"] <= a["s"] and a["e"] <= b["e"] or a["s"] <= b["s"] and b["e"] <= a["e"]:
            return 0
        if min(abs(a["s"] - b["s"]), abs(a["e"] - b["e"])) < min(a["e"] - a["s"], b["e"] - b["s"]) // 5:
            return 0
        return 1 if a["s"] < b["s"] else -1

    def joined(a, b):
        weigh = lambda k: round((a[k] * len(a["ids"]) + b[k] * len(b["ids"])) / (len(a["ids"]) + len(b["ids"])))
        return {"s": weigh("s"), "e": weigh("e"), "s0": min(a["s0"], b["s0"]), "e1": max(a["e1"], b["e1"]), "ids": a["ids"] + b["ids"], "v": a["v"] + b["v"]}

    out = []
    for chrom in sorted({r[1] for r in rows}):
        flows = [[{"s": r[3], "e": r[4], "s0": r[3], "e1": r[4], "ids": [r[2]], "v": [r[5]]} for r in sorted(rows, key=lambda r: (r[3], r[4], r[5])) if r[1] == chrom and r[2] == k] for k in range(n)]
        while len(flows) > 1:
            a, b, made = flows.pop(0), flows.pop(0), []
            i = j = 0
            while i < len(a) and j < len(b):
                s = status(a[i], b[j])
                made.append(joined(a[i], b[j]) if s == 0 else a[i] if s == 1 else b[j])
                i, j = i + (s >= 0), j + (s <= 0)
            flows.append(made + a[i:] + b[j:])
        out += [(chrom, r["s"], r["e"], r["s0"], r["e1"], r["ids"], r["v"]) for r in flows[0]]
    return sorted(out)


@pytest.mark.parametrize("reach,near", [(3_000, 1 << 20), (60_000, 500), (60_000, 1 << 20)])
def test_merge_by_islands_equals_the_tournament_over_whole_flows(spark, monkeypatch, reach, near):
    monkeypatch.setattr(intervals, "NEIGHBOURS", near)
    rows = random_peaks(random.Random(reach), 400, reach)
    peaks = spark.createDataFrame(rows, PEAKS)
    key = lambda r: (r.chrom, r.start_pos, r.end_pos, r.start_min, r.end_max, r.cell_ids, r.values1)
    want = plain_tournament(rows, 4)
    assert sorted(map(key, intervals.merged_peaks(peaks).collect())) == want
    flows = [intervals.singletons(peaks.where(F.col("cell_id") == c)) for c in range(4)]
    assert sorted(map(key, intervals.merge_all(flows).collect())) == want
    two = plain_tournament([r for r in rows if r[2] < 2], 2)
    assert sorted(map(key, intervals.merge_join(*flows[:2]).collect())) == two
    with pytest.raises(ValueError):
        intervals.merge_all([])
    assert intervals.merged_peaks(peaks.where("false")).count() == 0


def test_merged_pairs_are_what_the_flows_make(spark):
    """Each pair as the merge of two flows of one row; no pair is a group of its own, which takes milliseconds a pair."""
    import random

    rnd = random.Random(12)
    pairs = []
    while len(pairs) < 20_000:
        start, other = rnd.randrange(10**12), rnd.randrange(40)
        a, b = (start, start + rnd.randrange(1, 60)), (start + other - 20, start + other - 20 + rnd.randrange(1, 60))
        if intervals._status((None, *a), (None, *b)) == 0:
            pairs.append((len(pairs), *a, *b))
    row = lambda s, e: ("chr1", s, e, s, s, e, e, [0], [0.0], [0.0])
    want = {}
    for k, *p in pairs:
        (merged,) = intervals.merge_flows(iter([row(*p[:2])]), iter([row(*p[2:])]))
        want[k] = merged[1:7]
    found = intervals.merged_pairs(spark.createDataFrame(pairs, "k long, a_start_pos long, a_end_pos long, b_start_pos long, b_end_pos long"), ["k"])
    assert {r.k: tuple(r)[1:] for r in found.collect()} == want


def test_merge_pair_projection_makes_no_group_a_pair(spark, tmp_path):
    from strandloom.plans import registry

    spark.sql("select id event_id, timestamp'2024-01-01 00:01:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as decimal(18, 6))) ts, 1L user_id, if(id % 2 = 0, 'a', 'b') event_type, 1d value from range(10)").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["merge_pair_projection"](spark, str(tmp_path))
    assert found.count() > 0 and "FlatMapGroupsIn" not in found._jdf.queryExecution().toString()

def test_merge_join_may_repeat_the_tail(spark):
    flows = [intervals.singletons(spark.createDataFrame([(0, "chr1", k, s, e, 1.0, 1.0) for s, e in rows], PEAKS)) for k, rows in enumerate(([(0, 100)], [(10, 90), (200, 300)]))]
    plain = lambda **o: sorted((r.start_pos, r.end_pos) for r in intervals.merge_join(*flows, **o).collect())
    assert plain() == [(5, 95), (200, 300)] and plain(emulate_tail_dup=True) == [(5, 95), (10, 90), (200, 300)]


@pytest.mark.parametrize("queue", ["all", "chromosome"])
def test_background_regions_equal_a_plain_scan(spark, queue):
    rnd = random.Random(12)
    rows = []
    for c in ("chr10", "chr2", "chr1", "chrX"):
        at = 0
        for _ in range(60):
            at += rnd.randint(1, 900)
            n, cells = rnd.randint(60, 400), rnd.randint(1, 3)
            rows.append((c, at, at + n, at, at, at + n, at + n, list(range(cells)), [rnd.choice([100.0, 500.0])] * cells, [1.0] * cells))
            at += n
    want, waiting = [], []
    for c in ("chr1", "chr2", "chr10", "chrX"):
        last = 0
        if queue == "chromosome":
            waiting = []
        for r in sorted(r for r in rows if r[0] == c):
            while r[1] - last > 100 and waiting and waiting[0] < r[1] - last:
                size = waiting.pop(0)
                want.append(("noise", c, last, size))
                last += size
            last = r[2]
            if len(r[7]) >= 2 and r[8][0] >= 200 and r[2] - r[1] >= 100:
                want.append(("peak", c, r[1], r[2] - r[1]))
                waiting.append(r[2] - r[1])
    merged = spark.createDataFrame(rows, intervals.MERGED).repartition(4)
    assert sorted(map(tuple, intervals.regions(merged, queue=queue).collect())) == sorted(want)
    placed = intervals.regions(merged, queue=queue, seed=5).collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, intervals.regions(merged.repartition(2), queue=queue, seed=5).collect()))
    with pytest.raises(ValueError):
        intervals.regions(merged, queue="other")


def test_projections_and_bounds_of_merged_peaks(spark):
    rows = [("chr1", 5, 95, 0, 10, 90, 100, [0, 1], [339.7, 12.0], [1.0, 1.0]), ("chr1", 200, 300, 200, 200, 300, 300, [1], [8.5], [1.0]), ("chr1", 9000, 9900, 9000, 9000, 9900, 9900, [1], [900.5], [1.0])]
    merged = spark.createDataFrame(rows, intervals.MERGED)
    assert [r.x for r in merged.orderBy("start_pos").select(intervals.is_strict().alias("x")).collect()] == [False, True, True]
    assert tuple(intervals.bar_bounds(merged, 0, 400).first()) == ("chr1", 0, 300, 339)
    status = spark.createDataFrame([(None,), (True,), (False,)], "p boolean").select(intervals.status_of(F.col("p")).alias("x")).collect()
    assert [r.x for r in status] == ["Unknown", "Present", "NotPresent"]


def test_background_regions(spark):
    rows = [(500, 700, 2, 300.0, 200), (900, 1050, 1, 500.0, 150), (2000, 2150, 3, 250.0, 150), (2400, 2800, 2, 250.0, 400), (5000, 5100, 2, 201.0, 100)]
    merged = spark.createDataFrame(
        [("chr1", s, s + n, s, s, e, e, list(range(c)), [v] * c, [v] * c) for s, e, c, v, n in rows], intervals.MERGED
    )
    found = intervals.regions(merged)
    got = {k: sorted((r.start, r.size) for r in found.where(F.col("kind") == k).collect()) for k in ("peak", "noise")}
    assert got == {"peak": [(500, 200), (2000, 150), (2400, 400), (5000, 100)], "noise": [(1050, 200), (2150, 150), (2800, 400)]}
    placed = intervals.regions(merged, seed=3)
    assert sorted(r.size for r in placed.where("kind = 'noise'").collect()) == [150, 200, 400]
    summary = {r.kind: (r.n, r.total) for r in intervals.region_summary(found).collect()}
    assert summary == {"peak": (4, 850), "noise": (3, 750)}


def test_low_complexity(spark):
    words = ["ATGCATGCAT", "AAAAATGCTG", "CCATGATGAT", "CCCATGATGA", "AAAAAATGCT"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(S.is_complex("w").alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, False, False]


def plain_groups(fragments, least, most):
    seen = {}
    for f, text in enumerate(fragments):
        end = "Z" if f == len(fragments) - 1 else "E"
        for i in range(len(text)):
            for k in range(least, min(most, len(text) - i) + 1):
                seen.setdefault(text[i : i + k], []).append(text[i + k] if i + k < len(text) else end)
    kept = {w: len(n) for w, n in seen.items() if len(n) >= 2 and len(set(n)) >= 2}
    kept = {w: n for w, n in kept.items() if not w.startswith("CCC") and max(w.count(b) for b in "ATGC") < 2 * len(w) // 3}
    order = sorted(kept, key=lambda w: "".join(str("ATGC".index(c)) for c in w) + "~")
    out = {}
    for i, w in enumerate(order):
        after = order[i + 1] if i + 1 < len(order) else None
        if not (after and len(after) < len(w) and w.startswith(after) and kept[after] > kept[w]):
            out[w] = kept[w]
    return out


def test_element_groups(spark):
    def got(fragments, least, most=100):
        seqs = spark.createDataFrame(list(enumerate(fragments)), "frag_id long, seq string")
        return {r.word: r.cnt for r in W.element_groups(seqs, least, most).collect()}

    assert got(["ATGCATGAT", "GATGCATTC", "TATGCA"], 3) == {"ATG": 4, "TGCA": 3, "GAT": 2, "GCA": 3, "CAT": 2}
    rnd = random.Random(6)
    for _ in range(3):
        fragments = [dna(rnd, rnd.randint(0, 40)) for _ in range(8)]
        fragments.append(fragments[0] + "ATG" + fragments[1])
        assert got(fragments, 4, 20) == plain_groups(fragments, 4, 20)


def test_partial_search_equals_brute_force(spark):
    rnd = random.Random(7)
    texts, patterns = [dna(rnd, 60) for _ in range(5)], [dna(rnd, 12) for _ in range(4)]
    patterns[0] = texts[0][10:22]
    want = set()
    for p in patterns:
        for f, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(len(p)):
                    n = 0
                    while i + n < len(t) and j + n < len(p) and t[i + n] == p[j + n]:
                        n += 1
                    if n >= 4:
                        want.add((p, f, i, j, n))
    seqs = spark.createDataFrame(list(enumerate(texts)), "frag_id long, seq string")
    found = W.partial_cites(seqs, spark.createDataFrame([(p,) for p in patterns], "word string"), 4)
    assert {(r.pattern, r.frag_id, r.text_pos, r.pattern_pos, r.length) for r in found.collect()} == want


def test_modularity_groups_and_total(spark):
    groups = [0, 0, 0, 1, 1, 1, 1]
    w = [[200 if i == j else 100 if groups[i] == groups[j] else 0 for j in range(7)] for i in range(7)]
    for seed in range(20):
        for small in (True, False):
            assert cluster.greedy(w, seed, small) in ([0, 0, 0, 1, 1, 1, 1], [1, 1, 1, 0, 0, 0, 0])
    edges = spark.createDataFrame([(i, j, w[i][j]) for i in range(7) for j in range(i + 1)], "i long, j long, w long")
    q = lambda c: cluster.modularity(edges, spark.createDataFrame(list(enumerate(c)), "id long, cluster long")).first().q
    assert q(range(7)) == pytest.approx(0.234404536862) and q(groups) == pytest.approx(0.438563327032)


def motifs_of(spark, rows, factors):
    frame = spark.createDataFrame([(0, i, r, f) for i, (r, f) in enumerate(zip(rows, factors, strict=True))], "cluster long, id long, row string, cnt long")
    return motif.extract(align.columns(frame, "cnt"))


def test_position_frequencies(spark):
    m = motifs_of(spark, ["TGGCTGGCT", "TGCCTGCCT", "TCGCTCGCT", "TGGGTGGGT"], [100, 1000, 100, 100])
    rows = m.orderBy("pos").collect()
    assert (rows[0].cnt, [rows[1].g, rows[1].c], [rows[2].g, rows[2].c]) == (1300, [1200, 100], [300, 1000])
    packed = motif.packed(m).first()
    assert packed["mask"] == "TGCCTGCCT"
    assert motif.packed(motifs_of(spark, ["GCCGGCCGGC", "GGCCGGCCGG"], [1, 1])).first()["mask"] == "GgCgGgCgGg"
    ragged = motif.packed(motifs_of(spark, ["  ATG", "ATATG", "  AT"], [1, 1, 1])).first()
    assert (ragged["mask"], ragged.cnt, ragged.freq) == ("ATG", 3, [[3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 2, 0]])
    for mode, bad in (("eps", 1 / 3), ("strict", 0.0), ("degree", 1 / 30)):
        s = motif.Scorer(ragged.freq, ragged.norm, 3, mode)
        assert s.scores(motif.turned("ATGCC")[0])[0] == pytest.approx(1) and s.scores(motif.turned("ACGCC")[0])[0] == pytest.approx(bad)
        full = motif.Scorer(packed.freq, packed.norm, packed.cnt, mode)
        for text, want in (("TGCCTGCCTA", 1), ("TGGCTGGCTA", 0.09), ("TGCCTGCCT", 0), ("ATGCCTGCCTAA", 1)):
            assert motif.max_score(text, [full]) == pytest.approx(want)
    s = motif.Scorer(ragged.freq, ragged.norm, 3, "eps")
    assert [round(motif.max_score_between("CATGCATGCC", s, a, b), 6) for a, b in ((0, 10), (2, 5), (6, 9), (9, 3))] == [1, *(round(max(s.scores(motif.turned("CATGCATGCC")[0])[a:b]), 6) for a, b in ((2, 5), (6, 9))), 0]
    with pytest.raises(ValueError):
        motif.Scorer([[1, 0, 0, 0]], [1], 1, "other")


def test_scores_of_short_and_empty_sequences(spark):
    m = motifs_of(spark, ["ATG"], [1])
    seqs = spark.createDataFrame([(1, ""), (2, "AT"), (3, "ATG"), (4, "ATGA"), (5, None)], "frag_id long, seq string")
    assert {r.frag_id: round(r.score, 6) for r in motif.max_scores(seqs, m).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    assert {r.frag_id: round(r.score, 6) for r in motif.max_scores(seqs, m, inclusive=True).collect()}[3] == 1


@pytest.mark.parametrize(
    "args,want", [((10, 2, 100, 100), 4.266615), ((2, 10, 100, 100), -0.833333), ((0, 0, 1, 1), -1), ((5, 5, 100, 50), 0), ((5, 5, 50, 100), 1.992233), ((100, 0, 100, 100), 135.753236)]
)
def test_informativity(spark, args, want):
    assert one(spark, scores.informativity(*[F.lit(a) for a in args])) == pytest.approx(want, abs=1e-6)


def test_ln_factorial(spark):
    got = spark.range(0, 300).select(scores.ln_factorial(F.col("id")).alias("x")).collect()
    assert all(r.x == pytest.approx(math.lgamma(i + 1), abs=1e-9) for i, r in enumerate(got))


def test_area_under_the_curve(spark):
    rows = [("m", "peak", v) for v in (0.95, 0.8, 0.35, 0.6)] + [("m", "noise", v) for v in (0.1, 0.7, 0.3, 0.2)]
    curve = evaluate.roc(spark.createDataFrame(rows, "motif_id string, side string, score double"), 10)
    assert curve.count() == 11 and evaluate.auc(curve).first().auc == pytest.approx(0.84375)
    points = {round(r.thr, 1): (r.x, r.y) for r in curve.collect()}
    assert points[0.0] == (100, 100) and points[0.3] == (50, 100) and points[0.7] == (25, 50)


def test_slices_and_round_trips(spark):
    rnd = random.Random(8)
    seqs = {"a": dna(rnd, 333), "b": dna(rnd, 64), "c": "A"}
    chunks = views.chunked(spark.createDataFrame(list(seqs.items()), "chrom string, seq string"))
    assert {r.chrom: r.seq for r in slices.whole(chunks).collect()} == seqs
    wanted = [(c, rnd.randrange(len(s)), rnd.randint(1, 200)) for c, s in seqs.items() for _ in range(10)]
    got = slices.range_slice(chunks, spark.createDataFrame(wanted, "chrom string, start long, size long").distinct())
    assert {(r.chrom, r.start, r.size): r.seq for r in got.collect()} == {(c, a, n): seqs[c][a : a + n] for c, a, n in wanted}
    more = slices.append(chunks, spark.createDataFrame([("c", "GTCG"), ("b", "TT")], "chrom string, seq string"))
    assert {r.chrom: r.seq for r in slices.whole(more).collect()} == {**seqs, "c": "AGTCG", "b": seqs["b"] + "TT"}
    masks = {0: "ATGC" * 4, 1: "NN" + "A" * 14, 2: "A" * 5 + "N" * 11}
    runs = slices.runs(spark.createDataFrame(list(masks.items()), "frag_id long, seq string"), "ATGC")
    assert {r.frag_id: r["mask"] for r in slices.from_runs(runs).collect()} == {k: "".join("0" if c == "N" else "1" for c in v) for k, v in masks.items()}


def test_fasta_files(spark, tmp_path):
    import gzip

    rnd = random.Random(9)
    seq = dna(rnd, 250)[:100] + "NNNN" + dna(rnd, 96)
    lines = [seq[i : i + 50] for i in range(0, len(seq), 50)]
    (tmp_path / "chr1.fa").write_text(">chr1\n" + "\n".join(lines[:2] + [lines[2].lower(), *lines[3:]]) + "\n")
    with gzip.open(tmp_path / "chr1.fa.gz", "wt") as f:
        f.write(">chr1\n" + "\n".join(lines) + "\n")
    for name in ("chr1.fa", "chr1.fa.gz"):
        rows = files.read_fasta(spark, str(tmp_path / name), "Chr1").orderBy("start_pos").collect()
        assert "".join(r.seq for r in rows) == seq.replace("N", "A") and [r.start_pos for r in rows] == [0, 50, 100, 150]
    kept = files.read_fasta(spark, str(tmp_path / "chr1.fa.gz"), unknown="N").orderBy("start_pos").collect()
    assert "".join(r.seq for r in kept) == seq and {r.chrom for r in kept} == {"chr1"}
    with pytest.raises(Exception, match="unexpected first line"):
        files.read_fasta(spark, str(tmp_path / "chr1.fa"), "chr2").collect()
    (tmp_path / "bad.fa").write_text(">x\nATXG\n")
    with pytest.raises(Exception, match="unexpected symbol"):
        files.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_fasta_files_that_are_no_good(spark, tmp_path):
    for name, text in {"none": "ATGC\nATGC\n", "late": "ATGC\n>chr1\nATGC\n", "blank": "\n>chr1\nATGC\n"}.items():
        (tmp_path / f"{name}.fa").write_text(text)
        for chrom in (None, "chr1"):
            with pytest.raises(Exception, match="unexpected first line"):
                files.read_fasta(spark, str(tmp_path / f"{name}.fa"), chrom).collect()
    (tmp_path / "two.fa").write_text(">chr1 notes\nATGC\n>other\nGG\n")
    assert [(r.chrom, r.start_pos, r.seq) for r in files.read_fasta(spark, str(tmp_path / "two.fa")).orderBy("start_pos").collect()] == [("chr1 notes", 0, "ATGC"), ("chr1 notes", 4, "GG")]
    (tmp_path / "soft.fa").write_text(">c\nATgcN\n")
    assert files.read_fasta(spark, str(tmp_path / "soft.fa"), unknown="N", soft_mask=True).first().seq == "ATgcN"


def test_pieces_of_any_size_become_chunks(spark):
    rnd = random.Random(13)
    text = dna(rnd, 500)
    cuts = sorted(rnd.sample(range(1, 500), 20))
    pieces = [("c", a, text[a:b]) for a, b in zip([0, *cuts], [*cuts, 500], strict=True)]
    chunks = views.rechunked(spark.createDataFrame(pieces, "chrom string, start_pos long, seq string").repartition(3), 64)
    rows = chunks.orderBy("chunk_no").collect()
    assert [r.seq for r in rows] == [text[i : i + 64] for i in range(0, 500, 64)] and [r.start_pos for r in rows] == list(range(0, 500, 64))
    grown = slices.append(chunks, spark.createDataFrame([("c", "GGG" * 50), ("new", "AT"), ("empty", "")], "chrom string, seq string"))
    assert {r.chrom: r.seq for r in slices.whole(grown).collect()} == {"c": text + "GGG" * 50, "new": "AT"}
    assert max(r.n for r in grown.select(F.length("seq").alias("n")).collect()) == 64
    assert {r.chrom: r.seq for r in slices.whole(slices.append(chunks.where("false"), spark.createDataFrame([("c", "ATG")], "chrom string, seq string"))).collect()} == {"c": "ATG"}


def plain_weight(a, b):
    return max(sum(x == y for x, y in zip(a[max(0, len(a) - s - 1) :], t[max(0, s + 1 - len(a)) :], strict=False)) for t in turned(b) for s in range(len(a) + len(b) - 1))


def test_weight_table_and_clusters_of_all_words(spark):
    rnd = random.Random(14)
    words = [dna(rnd, rnd.randint(4, 13)) for _ in range(40)]
    table = cluster.weight_table(words)
    assert all(table[i, j] == (0 if i == j else plain_weight(words[i], words[j])) for i in range(40) for j in range(40))
    frame = spark.createDataFrame([(i, w, 1 + i % 3) for i, w in enumerate(words)], "id int, word string, cnt long")
    edges = cluster.graph(frame, align.all_pairs(frame), 5)
    plain = {r.id: r.cluster for r in cluster.clusters(edges, 7).collect()}
    whole = {r.id: r for r in cluster.clustered(frame, 5, 7).collect()}
    assert {i: r.cluster for i, r in whole.items()} == plain
    assert all(r.total == sum(int(table[i, j]) for j in range(40) if j != i and plain[j] == plain[i]) for i, r in whole.items())
    inner = cluster.inner_edges(edges, cluster.clusters(edges, 7)).collect()
    assert len(inner) == sum(plain[i] == plain[j] for i in range(40) for j in range(i + 1)) and all(plain[r.i] == plain[r.j] == r.cluster for r in inner)
    sums = cluster.clustered(frame, 5, 7).select("cluster", "id", "total")
    own = frame.join(sums.drop("total"), "id")
    rows = lambda **o: sorted(map(tuple, align.multiple(own, **o).collect()))
    assert rows(sums=sums) == rows()


def test_clustering_holds_a_byte_a_pair_and_deals_the_weights(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    rnd = random.Random(21)
    base = [dna(rnd, 11) for _ in range(40)]
    words = sorted({w[:k] + rnd.choice("ACGT") + w[k + 1 :] for w in base for k in range(11) for _ in range(4)})
    table = cluster.weight_table(words)
    wide = table.astype(np.int64) - 6
    np.fill_diagonal(wide, 3)
    want = cluster.greedy(wide, 2)
    assert 5 < len(set(want)) < len(words) / 4, len(set(want))
    tracemalloc.start()
    try:
        assert cluster.greedy(table, 2, cut=6, own=np.full(len(words), 3)) == want
        assert tracemalloc.get_traced_memory()[1] < 3 * len(words) ** 2
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(cluster, "BLOCK", 100)
    frame = spark.createDataFrame([(2 * i, w, 3) for i, w in enumerate(words)], "id int, word string, cnt long")
    found = {r.id: r.cluster for r in cluster.clustered(frame, 6, 2, core_weights=True).collect()}
    assert found == {2 * i: c for i, c in enumerate(want)}
    blocks = cluster.weight_blocks(frame.selectExpr("cast(id / 2 as long) id", "word"))
    assert blocks.rdd.getNumPartitions() > 1
    for r in blocks.collect():
        rows = slice(100 * r.i, 100 * r.i + 100), slice(100 * r.j, 100 * r.j + 100)
        made = np.frombuffer(r.weights, dtype=np.uint8).reshape(table[rows].shape).copy()
        if r.i == r.j:
            np.fill_diagonal(made, 0)
        assert np.array_equal(made, table[rows])
    assert cluster.clustered(frame.where("false")).count() == 0

def test_many_short_rows_are_scored_together():
    """Equal to one at a time, bit by bit; what a cross test calls takes one pass a motif and length, not one a row."""
    import numpy as np

    from strandloom.operators import motif

    rnd = random.Random(31)
    seqs = ["", "A", *["".join(rnd.choices("ATGCN", k=rnd.choice((5, 9, 12)))) for _ in range(300)], dna(rnd, 400)]
    groups = list(motif.by_length(seqs))
    assert len(groups) == 6
    for mode in motif.MODES:
        scorer = motif.Scorer([[rnd.randrange(5) for _ in range(3)] + [1] for _ in range(6)], [9] * 6, 10, mode)
        for inclusive in (False, True):
            got = np.full(len(seqs), -1.0)
            for at, oriented in groups:
                got[at] = motif.max_of_each(oriented, scorer, inclusive)
            assert got.tolist() == [motif.max_score(x, [scorer], None, inclusive) for x in seqs]

def plain_greedy(w, seed):
    """Greedy merges over dictionaries of sets; the order of a pass is the seed's."""
    import hashlib

    n = len(w)
    groups = [[i] for i in range(n)]
    total = sum(w[i][j] for i in range(n) for j in range(i + 1))
    while True:
        alive, merged = dict(enumerate(groups)), False
        between = lambda a, b: sum(w[i][j] for i in a for j in b)
        outer = lambda a: sum(w[i][j] for i in a for j in range(n) if j not in a)
        for src in sorted(alive, key=lambda i: hashlib.md5(f"{seed}:{len(groups)}:{i}".encode()).digest()):
            if len(alive) == 1:
                break
            best = max((d for d in sorted(alive) if d != src), key=lambda d: (between(alive[src], alive[d]) / (2 * total) - 2 * (outer(alive[d]) / (2 * total)) * (outer(alive[src]) / (2 * total)), -d))
            if between(alive[src], alive[best]) / (2 * total) - 2 * (outer(alive[best]) / (2 * total)) * (outer(alive[src]) / (2 * total)) > 0:
                alive[best] = alive[best] + alive[src]
                del alive[src]
                merged = True
        groups = [alive[k] for k in sorted(alive)]
        if not merged or len(groups) == 1:
            return sorted(map(sorted, groups))


def test_greedy_equals_a_plain_restatement_and_keeps_its_invariants():
    import numpy as np

    rnd = random.Random(15)
    for seed in range(12):
        n = rnd.randint(2, 14)
        w = [[0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i + 1):
                w[i][j] = w[j][i] = rnd.choice([0, 0, 1, 5, 9, -1])
        if sum(w[i][j] for i in range(n) for j in range(i + 1)) > 0:
            found = cluster.greedy(w, seed)
            assert sorted(sorted(i for i in range(n) if found[i] == c) for c in set(found)) == plain_greedy(w, seed)
    with pytest.raises(AssertionError):
        cluster.check(np.zeros(2), [[0]], np.zeros(1), np.zeros(1))
    with pytest.raises(AssertionError):
        cluster.check(np.array([3, 4]), [[0], [1]], np.array([1, 0]), np.array([2, 5]))


def test_small_functions(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "ATG "), (0, 1, " TGC")], "cluster long, id long, row string")
    weights = align.row_weights(rows, spark.createDataFrame([(0, "ATGg")], "cluster long, mask string"))
    assert {r.id: r.weight for r in weights.collect()} == {0: 3, 1: 2}
    assert one(spark, evaluate.curve_label(F.lit(8))) == pytest.approx(math.log(8))
    assert one(spark, S.rendered(F.lit("ANG"))) == "A G" and one(spark, S.soft_mask_folded(F.lit("aNg"))) == "ANG" and one(spark, S.base_at(F.lit("ATG"), F.lit(2))) == "G"
    assert one(spark, scores.score_text(F.lit(10), F.lit(2), F.lit(100), F.lit(100))) == "Score,pnPN=(10, 2, 100, 100), Inf=4.2666"
    assert one(spark, scores.fisher_information(F.lit(5), F.lit(0), F.lit(4), F.lit(9))) is None
    words = spark.createDataFrame([("AT",), ("GC",)], "word string")
    assert [r.word for r in search.unseen(words, words.where("word = 'AT'")).collect()] == ["GC"]
    assert search.mutated_by_order("ATGC", 0.5, random.Random(1))[2:] == "GC" and search.mutated_by_order("ATGC", 0.0, random.Random(1))[1:] == "TGC"
    changed = search.mutated("ATGCATGC", 3, random.Random(2), "any")
    assert sum(a != b for a, b in zip(changed, "ATGCATGC", strict=True)) == 3
    files.write_table(words, str(tmp_path / "t"))
    assert sorted(r.word for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()) == ["AT", "GC"]
    from strandloom.operators import collections_ext

    order = lambda seed: [r.id for r in collections_ext.shuffled(spark.range(50), "id", seed).collect()]
    assert order(1) == order(1) != order(2) and sorted(order(2)) == list(range(50))
    found = spark.createDataFrame([(1, 5, 0, 8), (1, 5, 2, 9), (0, 9, 0, 8), (1, 5, 1, 9)], "frag_id long, text_pos long, pattern_pos long, length long")
    assert [tuple(r) for r in W.in_match_order(found).collect()] == [(0, 9, 0, 8), (1, 5, 1, 9), (1, 5, 2, 9), (1, 5, 0, 8)]
    m = motifs_of(spark, ["ATG"], [1])
    asked = spark.createDataFrame([(1, "CATGC", 0, 5), (2, "CATGC", 2, 5), (3, None, 0, 9)], "frag_id long, seq string, start long, end long")
    assert {r.frag_id: round(r.score, 6) for r in motif.scores_between(asked, m).collect()} == {1: 1, 2: round(motif.max_score_between("CATGC", motif.Scorer([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], [1, 1, 1], 1, "degree"), 2, 5), 6), 3: 0}


def test_multiple_alignment_to_the_base(spark):
    """The base is the word of the greatest summed weight; with ``align_to='base'`` others are shifted against it."""
    words = spark.createDataFrame([(0, 0, "TTTTTT", 1), (0, 1, "CATGCA", 1), (0, 2, "ATGCAC", 1), (0, 3, "GCATGC", 1)], "cluster long, id long, word string, cnt long")
    rows = {r.id: r for r in align.multiple(words, "base").collect()}
    table = cluster.weight_table(["TTTTTT", "CATGCA", "ATGCAC", "GCATGC"]).sum(axis=1)
    base = int(table.argmax())
    assert rows[base].direction == 0
    for i, r in rows.items():
        word = turned(words.where(F.col("id") == i).first().word)[r.direction]
        assert r.row == " " * r["shift"] + word
        if i != base:
            a = turned(words.where(F.col("id") == base).first().word)[0]
            offset = r["shift"] - rows[base]["shift"]
            same = sum(0 <= k + offset < len(a) and a[k + offset] == x for k, x in enumerate(word))
            assert same == plain_weight(a, words.where(F.col("id") == i).first().word)


def test_search_by_joins_equals_search_by_look_up(spark, monkeypatch):
    rnd = random.Random(16)
    sides = [spark.createDataFrame([(i, dna(rnd, 60)) for i in range(30)], "frag_id long, seq string") for _ in range(2)]
    rows = lambda: sorted(map(tuple, search.search(*sides, generations=3, pop_size=15, length=5, seed=4).collect()))
    by_table = rows()
    monkeypatch.setattr(search, "LOOKUP", 0)
    assert [(w, p, n) for w, p, n, *_ in rows()] == [(w, p, n) for w, p, n, *_ in by_table]
    monkeypatch.undo()
    run = search.Search(*sides, pop_size=15, length=3)
    while not run.finished:
        run.iterate()
    kept = {"".join(w) for w in __import__("itertools").product("ATGC", repeat=3)}
    assert {w for w in kept if not search.is_degenerate(w)} <= run.seen


def test_chromosome_cache(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return views.chunked(spark.createDataFrame([("a", "ATGC" * 40), ("b", "G")], "chrom string, seq string"))

    path = str(tmp_path / "genome")
    for _ in range(2):
        found = files.cached_chromosomes(spark, path, build)
        assert slices.whole(found.where("chrom = 'a'")).first().seq == "ATGC" * 40
    assert len(built) == 1


def test_peak_and_manifest_files(spark, tmp_path):
    (tmp_path / "p.narrowPeak").write_text("chr1\t566760\t566910\t.\t0\t.\t339\t157.884\t-1\t-1\nchr2\t5\t9\t.\t0\t.\t1.5\t2\t-1\t-1\n")
    rows = files.read_peaks(spark, str(tmp_path / "p.narrowPeak"), "chr1").collect()
    assert [(r.chrom, r.start_pos, r.end_pos, round(r.value2, 3)) for r in rows] == [("chr1", 566760, 566910, 157.884)]
    (tmp_path / "files.txt").write_text("a.gz\ttype=narrowPeak; view=Peaks; cell=X=1\nb.gz\ttype=broadPeak; view=Peaks\n\nc.gz\ttype=narrowPeak; view=Peaks\n")
    parsed = files.read_manifest(spark, str(tmp_path / "files.txt"))
    assert [r.attrs["cell"] for r in parsed.where("file_name = 'a.gz'").collect()] == ["X=1"]
    assert [r.file_name for r in files.matching_files(parsed, {"type": "narrowPeak", "view": "Peaks"}, 2).collect()] == ["a.gz", "c.gz"]
    assert files.matching_files(parsed, {"cell": "Y"}).count() == 0
    assert files.single_file(parsed, {"type": "broadPeak"}) == "b.gz"
    for wanted in ({"cell": "Y"}, {"type": "narrowPeak"}):
        with pytest.raises(ValueError):
            files.single_file(parsed, wanted)


def test_sizes_for_people(spark):
    cases = {0: "0B", 1023: "1023B", 1024: "1kB", 1536: "1kB", 5 << 20: "5MB", 3 << 50: "3EB", 1 << 61: "moreB"}
    for size, text in cases.items():
        assert one(spark, human.human_size(F.lit(size))) == text
    for size, text in {1536: "1536B", 2048: "2kB", 3 << 30: "3GB", (1 << 20) + 1: "1048577B"}.items():
        assert one(spark, human.human_size_strict(F.lit(size))) == text
        assert one(spark, human.parsed_size(F.lit(text))) == size
    assert one(spark, human.parsed_size(F.lit("x1kB"))) is None
    assert [one(spark, human.human_time(F.lit(v))) for v in (999, 1500, 90_000, 5_400_000, 172_800_000)] == ["999msec", "1.5sec", "1.5min", "1.5hrs", "2days"]


def test_search_operators(spark):
    rnd = random.Random(10)
    pos = [(i, dna(rnd, 20) + "ATGGCATT" + dna(rnd, 20)) for i in range(40)]
    neg = [(i, dna(rnd, 48)) for i in range(40)]
    frames = [spark.createDataFrame(x, "frag_id long, seq string") for x in (pos, neg)]
    words = spark.createDataFrame([("ATGGCATT",), ("ATGCGCAT",)], "word string")
    got = {r.word: r for r in search.fitness(words, W.counted(frames[0], 8), W.counted(frames[1], 8), search.totals(frames[0]), search.totals(frames[1])).collect()}
    for w, r in got.items():
        for side, value in ((pos, r.p), (neg, r.n)):
            assert value == sum(t[i : i + 8] == o for _, t in side for o in turned(w) for i in range(len(t) - 7))
    assert got["ATGGCATT"].inf > got["ATGCGCAT"].inf and (r.total_p, r.total_n) == (390, 390)
    run = search.Search(*frames, pop_size=40, length=4, seed=3)
    bests = []
    for _ in range(3):
        run.iterate()
        bests.append(run.scores[run.best][-1])
    assert bests == sorted(bests) and len(run.population) == len(set(run.population)) <= 40
    assert not any(search.is_degenerate(w) for w in run.population)
    assert search.mutated("ATGC", 2, rnd)[2:] == "GC" and len(search.crossed("AAAA", "TTTT", rnd)) == 4
