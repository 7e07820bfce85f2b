"""Operators on single texts against plain restatements of their contracts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandloom.llm import byte_bpe, language_id, pii, quality_rules, token_count, toxicity

P = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(n=300, seed=5):
    rnd = random.Random(seed)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "256.1.1.1", "97.51.17.173.9.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
            "+49.30.1234567", "++12", "the", "der", "é日", "\n", "\t", "\x0b", " ", "  ", "\x85", "\xa0", "#*$", "a b c d e", "a b c d e", "<|endoftext|>", "12345", "-", ".", "GB82 WEST 1234 5698 7654 32", "phone (017) 555-7713", "\x1c", "x" * 40, "7" * 25]
    return ["", " ", "\n\n", *("".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(1, 30))) for _ in range(n))]


def frame(spark, texts):
    rows = [(i, t, "en", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, spans string").repartition(3)


def plain_base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_pii_base_spans_are_those_of_the_plain_expressions():
    for text in odd_texts(2000):
        got = [(s, pii.KINDS.index(k), e) for s, k, e, _ in pii.spans(text) if k in pii.BASE]
        assert got == plain_base_spans(text), text


def test_pii_added_kinds_need_check_digits_or_context():
    kinds = lambda t: [k for _, k, _, _ in pii.spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33.") == []
    assert "local_phone" in kinds("phone: (017) 555-7713")
    assert "local_phone" not in kinds("lot (017) 555-7713")


def test_pii_is_linear_on_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "A1" * 100_000, "0 " * 100_000):
        pii.spans(text)


def test_pii_query_frame(spark):
    texts = odd_texts()
    out = {r.doc_id: r for r in pii.digest(pii.find(frame(spark, [*texts, None]))).collect()}
    for i, text in enumerate([*texts, ""]):
        base = plain_base_spans(text)
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert out[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(line.split(",")) - {""} <= set(out[i].spans.split(","))
    assert pii.digest(pii.find(frame(spark, texts).where("false"))).count() == 0


def test_redact_keeps_rows_and_columns(spark):
    docs = frame(spark, ["mail a@b.co now", "none", None])
    out = pii.redact(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {0: "mail <email> now", 1: "none", 2: None}


def plain_quality(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 5))
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures(spark):
    texts = [*odd_texts(), "a b c d e f " * 400, "w " * 9, "the " * 3000 + "end"]
    out = {r.doc_id: r for r in quality_rules.judge(frame(spark, [*texts, None])).collect()}
    for i, text in enumerate([*texts, ""]):
        want = plain_quality(text)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(frame(spark, texts).where("false")).count() == 0


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.judge(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_count_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter(path)
    texts = [*odd_texts(1500), "ab" * 3000, " " * 500, "<|endoftext|><|endoftext|>x"]
    for text in texts:
        assert count.text(text) == len(library.encode(text, add_special_tokens=False).ids), text
    rows = {r.doc_id: r for r in token_count.count_tokens(frame(spark, ["", None, "x é", "word " * 1024, "word " * 1025]), path).collect()}
    assert (rows[0].n_tokens, rows[1].n_tokens, rows[1].n_bytes, rows[2].n_bytes) == (0, 0, 0, 4)
    assert [rows[3].n_tokens, rows[3].over_limit] == [1025, True]


def test_token_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(token_count, "MEMO_WORDS", 3)
    count = token_count.Counter(P.path("byte_bpe_50k.json"))
    assert count.text("one two three four five one two") == 7


def test_byte_bpe_equals_the_library_and_round_trips(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, P.PATTERN)
    for text in odd_texts(500):
        for chunk, run in ((1, 2), (7, 3), (16_384, 4096)):
            packed = byte_bpe.encode_text(enc, text, chunk, run)
            assert np.frombuffer(packed, "<u4").tolist() == enc[0].encode_ordinary(text)
            assert byte_bpe.decode_ids(enc, packed) == text.encode()
    docs = frame(spark, ["some words", None, ""])
    out = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect()}
    assert [bytes(out[i].decoded) for i in range(3)] == [b"some words", b"", b""] and out[1].n_tokens == 0
    ids = byte_bpe.encode(docs, path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(ids, path, P.PATTERN).collect()} == {0: b"some words", 1: b"", 2: b""}


def test_byte_bpe_of_white_space_is_the_library_s():
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(2)
    white = " \n\t\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    texts = ["".join(rnd.choice([rnd.choice(white) * rnd.randint(1, 9), rnd.choice(["a", "7", ".", "\x1c", "\u200b", "é"])]) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    texts += [a + w * n + b for w in (" ", "\n", " \n", "\t") for n in (4095, 4096, 4097, 9000) for a in ("", "a") for b in ("", "b", "\nb", ".")]
    for text in texts:
        for run in (2, 4, 4096):
            assert np.frombuffer(byte_bpe.encode_text(enc, text, 16, run), "<u4").tolist() == enc[0].encode_ordinary(text), repr(text[:40])


def test_byte_bpe_of_very_long_runs_round_trips(spark):
    """Runs that the library itself refuses: at the start, in the middle, at the end, and all there is."""
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [f"{a}{w * 2_000_000}{b}" for w in (" ", "\n") for a, b in (("", ""), ("", "b c"), ("a b", ""), ("a b", "c d"))] + ["x" * 300_000, "word " * 200_000]
    out = {r.doc_id: r for r in byte_bpe.round_trip(frame(spark, texts), path, P.PATTERN).collect()}
    assert all(bytes(out[i].decoded) == t.encode() for i, t in enumerate(texts))


def test_byte_bpe_of_no_rows_and_repeated_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", 9, b"x"), (1, "a b", 9, b"x"), (None, "c", 9, b"x"), (1, "c", 9, b"x")], "doc_id long, text string, n_tokens int, ids binary")
    out = byte_bpe.round_trip(docs, path, P.PATTERN)
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in out.collect()) == [("1", 1, b"c"), ("1", 2, b"a b"), ("1", 2, b"a b"), ("None", 1, b"c")]
    assert byte_bpe.round_trip(docs.where("false"), path, P.PATTERN).count() == 0


def test_bytes_that_are_no_text_decode():
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    half = np.array(enc[0].encode_single_token(b"\xe6"), "<u4").tobytes()
    assert byte_bpe.decode_ids(enc, half) == b"\xe6"


SAMPLE = {"en": "the of and to in is that it was for on are with his they", "de": "der die und ist nicht ein eine auf mit für auch schön", "es": "el que los las una por con para está niño año"}


def language_rows(n=120):
    rnd = random.Random(3)
    return [(i, " ".join(rnd.choice(SAMPLE[lang].split()) for _ in range(rnd.randint(3, 40))), lang) for i in range(n) for lang in [list(SAMPLE)[i % 3]]]


def test_language_profiles(spark):
    rows = language_rows()
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 .!", "en"), (902, "", None)], "doc_id long, text string, lang string").repartition(3)
    profiles = language_id.prototypes(docs.where("doc_id % 2 = 0"))
    assert list(profiles) == ["de", "en", "es"]
    out = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    right = sum(out[i].lang_pred == lang for i, _, lang in rows if i % 2)
    assert right >= 57
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = language_id.prototypes(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_trigrams():
    letters, _ = language_id.vectors(128)
    codes = language_id.trigrams("Abc  déf!")
    plain = sum(np.roll(letters[c >> 12], 2) * np.roll(letters[c >> 6 & 63], 1) * letters[c & 63] for c in codes.tolist())
    assert np.array_equal(language_id.bundle(*language_id.counted(codes), 128), plain)


def test_toxicity_learns_and_holds_edge_cases(spark):
    rnd = random.Random(9)
    base = "on the ended of rest that sher ton with"
    rows = []
    for i in range(400):
        words = [rnd.choice(base.split()) for _ in range(rnd.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moronic", "scum"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, 1.5) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    out = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if i % 3 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out.values()) and out[900].score == out[901].score
    assert all(r.predicted == int(r.score >= 0.5) for r in out.values())
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.predict(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert all(r.predicted == 1 for r in toxicity.predict(docs, one).collect())


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    """An id with many rows trains once; the sample's rows are no more than asked for."""
    docs = spark.createDataFrame([(i % 30, f"row {i} of words {'scum' if i % 30 % 2 else 'fine'}") for i in range(900)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3 + [(None, 1)], "doc_id long, toxic int")
    fitted = []
    plain = toxicity.regress
    monkeypatch.setattr(toxicity, "regress", lambda columns, values, marks, scale: fitted.append(marks) or plain(columns, values, marks, scale))
    toxicity.fit(docs, labels, sample_rows=10)
    toxicity.fit(docs, labels)
    assert len(fitted[0]) <= 10 and len(fitted[1]) == 30 and fitted[1].sum() == 15


def plain_model(rows):
    """Log-count ratios and the best buckets by the definition, from (text, label)."""
    counts, n = np.zeros((2, toxicity.BUCKETS)), np.zeros(2)
    for text, label in rows:
        line = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        counts[label, list({gram_bucket(line[i : i + k]) for k in toxicity.ORDERS for i in range(len(line) - k + 1)})] += 1
        n[label] += 1
    return counts, n


def gram_bucket(gram):
    """A single n-gram's bucket: a rolling hash of its code points, a gap being 0."""
    rolling = None
    for c in gram:
        code = ((0 if c == " " else ord(c)) + 1) * 0x9E3779B1 % 2**32
        rolling = code if rolling is None else (rolling * 0x01000193 + code) % 2**32
    return (((rolling ^ (rolling >> 15)) * 0x85EBCA6B) % 2**32) >> (32 - toxicity.BITS)


def test_toxicity_features_and_scores_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    words = "some plain words of any kind über niño scum idiot fools".split()
    rows = [(i, " ".join(rnd.choice(words[: 8 if i % 3 else 11]) for _ in range(rnd.randint(1, 30))) + rnd.choice(["", " 12 ", "!!"]), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chosen = []
    plain = toxicity.choose
    monkeypatch.setattr(toxicity, "choose", lambda counts, n: chosen.append((counts.copy(), n)) or plain(counts, n))
    model = toxicity.fit(docs, docs)
    counts, n = plain_model([(t, y) for _, t, y in rows])
    assert np.array_equal(chosen[0][0], counts) and np.array_equal(chosen[0][1], n)
    for r in toxicity.predict(docs, model).collect():
        text = rows[r.doc_id][1]
        line = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        total = {}
        for k in toxicity.ORDERS:
            for i in range(len(line) - k + 1):
                f = model.feature[gram_bucket(line[i : i + k])]
                total[f] = total.get(f, 0) + 1
        margin = model.bias + sum(math.log1p(c * 1000 / (len(text) + toxicity.SHORT)) * model.weight[f] for f, c in total.items() if f)
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9


def test_a_score_of_one_half_is_toxic(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.uint16), np.zeros(1), 0.0)
    docs = spark.createDataFrame([(1, "any"), (1, "any"), (None, "x" * 1_000_000)], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in toxicity.predict(docs, model).collect()] == [(0.5, 1)] * 3
    assert toxicity.without_toxic(docs, model).count() == 0 and toxicity.predict(docs.where("false"), model).count() == 0


def test_secrets_need_context_and_variety():
    kinds = lambda t: [k for _, k, _, _ in pii.spans(t)]
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["secret"]
    assert kinds('build 04dbebab91ab85687d33eeaaf9ac699e1188f962') == [] and kinds("token aaaaaaaaaaaaaaaaaaaaaaaaa1") == []


def test_pii_scores_stand_beside_the_spans(spark):
    r = pii.digest(pii.find(frame(spark, ["mail a@b.co, lot 1.2.3.4"]), mask=False)).first()
    assert (r.spans, r.scores) == ("email:5:11,ip:17:24", "1.0,0.6")


def plain_language(text, profiles):
    """Cosines by the definition: bound, bundled trigram vectors, one at a time."""
    letters, _ = language_id.vectors(language_id.DIMENSIONS)
    codes = language_id.trigrams(text)
    total = sum((np.roll(letters[c >> 12], 2) * np.roll(letters[c >> 6 & 63], 1) * letters[c & 63] for c in codes.tolist()), np.zeros(language_id.DIMENSIONS))
    return {lang: float(total @ p / (np.linalg.norm(total) * np.linalg.norm(p))) for lang, p in profiles.items()}


def test_language_predictions_equal_brute_force_ties_and_repeats(spark):
    rows = language_rows(60)
    docs = spark.createDataFrame([*rows, (3, rows[3][1], "en"), (None, rows[4][1], None)], "doc_id long, text string, lang_pred string").withColumnRenamed("lang_pred", "lang")
    profiles = language_id.prototypes(docs.where("doc_id % 2 = 0"))
    out = language_id.predict(docs, profiles).collect()
    assert len(out) == 62 and language_id.predict(docs.where("false"), profiles).count() == 0
    for r in out:
        if r.doc_id is not None:
            cosines = plain_language(rows[r.doc_id][1], profiles)
            assert cosines[r.lang_pred] >= max(cosines.values()) - 1e-5 and abs(r.score - max(0.0, min(1.0, max(cosines.values())))) < 1e-4
    twice = {"b": profiles["en"], "a": profiles["en"]}
    assert {r.lang_pred for r in language_id.predict(docs, twice).collect()} == {"a"}


def test_language_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "the of and " * 300_000, "en"), (2, "1 " * 500_000, "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.prototypes(docs)).collect()}
    assert out[1].lang_pred == "en" and out[2].lang_pred == "und"


def test_token_counts_of_no_rows_repeats_and_an_own_column(spark):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, "c", 9)], "doc_id long, text string, n_tokens int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(docs, path).collect()) == [("1", 2), ("1", 2), ("None", 1)]
    assert token_count.count_tokens(docs.where("false"), path).count() == 0


def test_repeated_rows_are_each_judged(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co"), (1, "mail a@b.co"), (None, "a b")], "doc_id long, text string")
    assert pii.find(docs).count() == quality_rules.judge(docs).count() == 3
    long = spark.createDataFrame([(1, "word and words " * 100_000)], "doc_id long, text string")
    assert quality_rules.judge(long).first().n_words == 300_000 and pii.digest(pii.find(long)).first().n_email == 0


def test_held_out_remainders_match_zlib(spark):
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)
