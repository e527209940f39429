"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list. A priority queue holds the merge rank of each
neighbouring pair; the lowest rank (leftmost of equal ones) is merged, which makes new pairs and leaves the
entries of the old ones stale: they are skipped when they come up. Decoding concatenates the
vocabulary's strings. Words are independent, so tasks encode whole texts word by word and remember
words already encoded, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .tables import per_text

CACHE_WORDS = 300_000
#: The byte-level split pattern (a fixed value); white space is Unicode's.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 characters for themselves,
    the other bytes in order from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of a tokenizer file (type BPE, byte level, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.added, key=len, reverse=True))) + ")") if self.added else None
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.seen: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, by merging from the queue."""
        symbol = [self.first[b] for b in word.encode("utf-8")]
        n, merges = len(symbol), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # stale: one of the pair has been merged meanwhile
            symbol[i], symbol[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbol[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], merged, symbol[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbol[h], merged))
        return tuple(s for s in symbol if s >= 0)

    def _plain(self, text: str) -> list[int]:
        words, seen = WORDS.findall(text), self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.word(w)
        return list(chain.from_iterable(map(seen.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; added tokens are recognised wherever their text stands. Null is empty."""
        text = text or ""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[int] = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their vocabulary strings one after the other, special tokens included."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of that file, kept from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per input row."""
    def make():
        of = codec(tokenizer_path).encode
        return lambda text: (of(text),)

    return per_text(docs, "ids array<int>", make, id_col, text_col).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per input row; null ids decode as no ids."""
    def make():
        of = codec(tokenizer_path).decode
        return lambda ids: (of(ids or []),)

    return per_text(rows, "text string", make, id_col, ids_col).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per input row: each whole text is encoded and its
    ids decoded in one task, without sending the ids through Spark.

    Null texts are empty, and have no ids. Repeated rows give repeated rows, null ids stay null, an empty
    table gives an empty result, further columns are ignored."""
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def make():
        c = codec(tokenizer_path)

        def of(text):
            ids = c.encode(text)
            return len(ids), sha(",".join(map(str, ids))), sha(c.decode(ids))
        return of

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(docs, columns, make, id_col, text_col).withColumnRenamed("id", id_col)
