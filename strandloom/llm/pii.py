"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Kinds, in their order: email, ip, card, phone (the base), then iban, local_phone and secret (keys and tokens).
A proposal that its validator rejects (Luhn for cards, mod 97 for IBANs, parts up to 255 for
addresses, digit counts) is dropped and not tried again from another place. What is left gets its
kind's prior score, plus ``CONTEXT_GAIN`` if one of the kind's context words stands within
``CONTEXT_CHARS`` before it; it is reported if the score reaches ``THRESHOLD``. The base kinds'
priors reach it alone; of the added kinds an IBAN needs its check digits, a local phone number and a
secret a context word. The scores stand beside the spans in the result, so that a caller may ask for more than ``THRESHOLD``.

Offsets count code points, ends are exclusive. Spans of one kind never overlap; spans of two kinds may.

Edge cases: a null or empty text has no spans; texts may be of any length; equal starts are ordered by kind; repeated rows are
each searched; an empty table gives an empty result; other columns are ignored. Every scan is linear
in the text, also in runs of a hundred thousand digits or letters without a match.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, map_slices

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "secret")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "secret": 0.3}
CONTEXT = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|telefon|tél", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "local_phone": re.compile(r"phone|call|\btel\b|mobile|telefon|tél", re.I),
    "secret": re.compile(r"token|secret|\bkey|_key|password|passwd|credential|bearer|auth|schlüssel|clave|clé", re.I),
}
CONTEXT_CHARS, CONTEXT_GAIN, THRESHOLD = 40, 0.3, 0.5

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}(?:[\x20-][0-9]{3,4}){1,2}(?![0-9.])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")
#: Different characters that a secret has at least.
SECRET_CHARS = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Each at-sign with a domain takes the run of local characters before it; the same spans as a left-to-right match."""
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if found and start < at:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) < 4 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        whole = m.group().replace(" ", "")
        if 15 <= len(whole) <= 34 and mod97(whole):
            yield m.span()


def _local_phones(text: str):
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 13:
            yield m.span()


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        found = set(m.group())
        if len(found) >= SECRET_CHARS and any("0" <= c <= "9" for c in found) and any(c.isalpha() for c in found):
            yield m.span()


_HAS_DIGIT = re.compile(r"[0-9]")


def spans(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of a text, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", s) for s in _emails(text)]
    if _HAS_DIGIT.search(text):
        if text.count(".") >= 3:
            found += [("ip", s) for s in _ips(text)]
        found += [("card", s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", s) for s in _phones(text)]
        found += [("iban", s) for s in _ibans(text)]
        found += [("local_phone", s) for s in _local_phones(text)]
        found += [("secret", s) for s in _secrets(text)]
    kept = []
    for kind, (start, end) in found:
        near = CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start)
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(near))
        if score >= THRESHOLD:
            kept.append((start, kind, end, round(score, 3)))
    return sorted(kept, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def written(found: list[tuple[int, str, int, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in found)


def masked(text: str, found: list[tuple[int, str, int, float]]) -> str:
    """The text with each span replaced by its kind; what overlaps goes under the first span's kind."""
    parts, done = [], 0
    for start, kind, end, _ in found:
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = True) -> DataFrame:
    """(doc_id, spans, masked): spans is an array of (start, end, kind, score); masked, left out without ``mask``, is the text without them."""

    def work(_, cols):
        every = [spans(t) for t in cols["text"]]
        made = {"doc_id": cols["doc_id"], "spans": [[{"start": s, "end": e, "kind": k, "score": score} for s, k, e, score in f] for f in every]}
        return made | ({"masked": [masked(t, f) for t, f in zip(cols["text"], every, strict=True)]} if mask else {})

    source = id_and_text(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_slices(source, work, f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,score:double>>" + ", masked string" * mask)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; in the text each span is replaced by its kind. A null text stays null."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def _is(kind: str):
    return lambda k: F.when(k == kind, F.lit(1))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the spans and, in the same order, their scores as text, from ``find``."""
    line = lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _is(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op5_pii(spark, sf_dir: str) -> DataFrame:
    from strandloom.llm.common import table

    return digest(find(table(spark, sf_dir, "documents"), mask=False))
