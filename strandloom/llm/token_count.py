"""Token counts of a byte-level BPE vocabulary, without making any token.

A word's count is its number of initial symbols (bytes) less the merges made: a heap holds
the adjacent pairs by rank and place, a linked list holds the symbols that are left, and the
lowest-ranked pair is merged again and again. Only pair ranks are needed, no identifiers.

Edge cases: a null text counts as empty (no bytes, no tokens); equal ranks merge from the
left; repeated rows are each counted; an empty table gives an empty result; other columns
are ignored. Special strings in a text count as one token each, as the library's default has
it. Texts may be of any length; a run of any length costs n log n.
"""

from __future__ import annotations

import functools
import heapq
import json

from pyspark.sql import DataFrame

from strandloom.llm.common import id_and_text, map_slices

#: Words whose count is remembered by a worker; beyond it the memory is emptied, results don't change.
MEMO_WORDS = 400_000
#: Longer words are counted anew each time.
MEMO_CHARS = 64

#: The byte-level split, which the file names only by its flag; fixed text of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that the format writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Counter:
    """Counts tokens by the merges of a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_symbols()
        number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        raw = lambda s: bytes(back[c] for c in s)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            whole = number.setdefault(left + right, len(number))
            self.merges.setdefault(number[left] << 32 | number[right], (rank, whole))
        self.split = regex.compile(SPLIT).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        counter = self

        class Memo(dict):
            def __missing__(self, word):
                n = counter.word(word.encode())
                if len(word) <= MEMO_CHARS:
                    if len(self) >= MEMO_WORDS:
                        self.clear()
                    self[word] = n
                return n

        self.memo = Memo()

    def word(self, data: bytes) -> int:
        """Initial symbols less merges, by heap and linked list."""
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        symbol, right, left = list(data), [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbol[i] << 32 | symbol[i + 1]
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or symbol[i] << 32 | symbol[j] != pair or symbol[i] < 0:
                continue
            symbol[i], symbol[j] = merges[pair][1], -1
            merged += 1
            k = right[i] = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                new = symbol[i] << 32 | symbol[k]
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], i, new))
            h = left[i]
            if h >= 0:
                new = symbol[h] << 32 | symbol[i]
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], h, new))
        return n - merged

    def text(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.memo.__getitem__, self.split(text)))
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.memo.__getitem__, self.split(p))) for p in pieces)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def work(count, cols):
        n = [count.text(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    source = id_and_text(df, id_col, text_col)
    return map_slices(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", lambda: counter(path))


def op3_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from strandloom.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
