"""Licence scans: exact phrases, and fuzzy search for short notices.

Texts are reduced to their words (A-Z lower-cased), one space between. A notice of n characters may
be off by k = n // 10 edits (at least 1). Cut into k + 1 seeds, one seed of every such variant is exact:
seeds are located first, then the regex library's bounded-error matching verifies the edits in the
windows around them and gives the span of each notice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame

from .tables import per_text

# Phrases whose exact occurrence sets a base label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices searched with errors: (label, words[, exact]). ``exact`` are words that tell the notice from its
#: neighbours, which are fewer edits away than the notice may be off; a variant must have them unedited.
NOTICES = (
    ("gpl", "gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "3"),
    ("lgpl", "gnu lesser general public license", "lesser"),
    ("apache", "licensed under the apache license"),
    ("apache-2", "licensed under the apache license version 2 0", "2"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl-2", "subject to the terms of the mozilla public license", "mozilla"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("public-domain", "released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    label: str
    words: bytes
    edits: int
    exact: bytes  # words that every variant has, or none
    seeds: tuple[tuple[int, bytes], ...]  # (offset in the notice, exact piece)
    grams: tuple[bytes, ...]  # its trigrams; an edit changes at most three
    least: int  # so many of them stand in every variant
    first: regex.Pattern  # any variant, from the left
    best: regex.Pattern  # the variant with the fewest edits

    @staticmethod
    def of(label: str, words: str, exact: str = "") -> Notice:
        raw = words.encode()
        edits = max(1, len(raw) // 10)
        cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:]))
        grams = tuple(raw[i:i + 3] for i in range(len(raw) - 2))
        fuzzy = rb"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(raw, literal_spaces=True), edits)
        return Notice(label, raw, edits, exact.encode(), seeds, grams, len(grams) - 3 * edits, regex.compile(fuzzy), regex.compile(rb"(?b)" + fuzzy))


def normalised(text: str | None) -> bytes:
    """The words of a text with one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def phrase_places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the words of a phrase stand one after the other, overlaps included."""
    padded, target, out = b" " + words + b" ", b" " + phrase + b" ", []
    at = padded.find(target)
    number, counted = 0, 0
    while at >= 0:
        number += padded.count(b" ", counted, at)
        counted = at
        out.append(number)
        at = padded.find(target, at + 1)
    return out


def _windows(words: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Stretches in which a variant of the notice can lie, merged where they overlap."""
    reach, found = len(notice.words) + 2 * notice.edits, []
    for offset, seed in notice.seeds:
        at = words.find(seed)
        while at >= 0:
            found.append((max(0, at - offset - notice.edits), at - offset + reach))
            at = words.find(seed, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _word_end(words: bytes, at: int) -> int:
    """The end of the word at a place."""
    end = words.find(b" ", at) if at < len(words) else -1
    return end if end >= 0 else len(words)


def _variants(words: bytes, notice: Notice, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the variants in a stretch of whole words, without overlaps; of variants
    that overlap, the one with the fewest edits, then the first.

    The best search returns the best of all it is given, so it is given what can overlap the leftmost
    variant, and again what can overlap the one it found, until none there has fewer edits; the
    stretch before that one is searched again."""
    out = []
    reach = len(notice.words) + notice.edits
    while a < b:
        left = notice.first.search(words, a, b)
        if left is None:
            break
        start, stop, place = left.start(), left.end(), None
        while True:
            m = notice.best.search(words, start, min(b, _word_end(words, stop + reach)))
            if m is None or m.span() == place:
                break
            place, stop = m.span(), m.end()
            found = (*place, sum(m.fuzzy_counts))
        if place is None:  # the leftmost variant itself lies in the stretch
            found = (*left.span(), sum(left.fuzzy_counts))
        out += _variants(words, notice, start, found[0]) + [found]
        a = _word_end(words, found[1]) + 1
    return out


def _has(words: bytes, exact: bytes, a: int, b: int) -> bool:
    """Whether whole words stand in a stretch of whole words."""
    return not exact or b" " + exact + b" " in b" " + words[a:b].strip() + b" "


def _enough(window: bytes, notice: Notice) -> bool:
    """Whether as many trigrams of the notice stand in a stretch as any variant keeps."""
    return notice.least <= 0 or sum(g in window for g in notice.grams) >= notice.least


def notice_spans(words: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start byte, end byte, edits) of the notice's variants, in order and without overlaps. Of overlapping
    ones the best counts, and only if it has the notice's exact words; windows without these, or with fewer of the notice's trigrams than
    every variant has, aren't searched."""
    out, end = [], 0
    for a, b in _windows(words, notice):
        # Whole words at both ends, so that the pattern sees the true neighbours.
        a = max(words.rfind(b" ", 0, max(a, end)) + 1 if a else 0, end)
        b = _word_end(words, b)
        if not _has(words, notice.exact, a, b) or not _enough(words[a:b], notice):
            continue
        found = _variants(words, notice, a, b)
        out += [f for f in found if _has(words, notice.exact, f[0], f[1])]
        end = found[-1][1] + 1 if found else end
    return out


def _scan(text: str | None, phrases: list[tuple[bytes, str]], notices: list[Notice]) -> tuple:
    words = normalised(text)
    n_words = words.count(b" ") + 1 if words else 0
    starts, base = [], set()
    for phrase, label in phrases:
        if phrase in words:
            places = phrase_places(words, phrase)
            starts += places
            if places:
                base.add(label)
    found = []
    for notice in notices:
        if notice.exact in words and any(seed in words for _, seed in notice.seeds):
            for a, b, edits in notice_spans(words, notice):
                first = words.count(b" ", 0, a)
                found.append((notice.label, first, first + words.count(b" ", a, b) + 1, edits,
                              1.0 - edits / len(notice.words)))
    spans = []
    if found:
        places = [m.span() for m in WORD.finditer(text)]
        for label, first, after, edits, score in sorted(found, key=lambda f: (f[1], f[2], f[0])):
            spans.append({"label": label, "start": places[first][0], "end": places[after - 1][1], "first_word": first,
                          "words": after - first, "edits": edits})
    labels = base | {f[0] for f in found}
    score = 1.0 if base else max((f[4] for f in found), default=0.0)
    return (n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, spans)


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    notices array<struct(label, start, end, first_word, words, edits)>).

    ``start`` and ``end`` are code points of the original text. score is 1 with an exact phrase, else the
    largest share of unedited characters of a notice, else 0. Null and empty texts have no words,
    labels or places (null first and last word). Repeated rows give repeated rows; null ids stay; an
    empty table gives an empty result; further columns are ignored."""
    def make():
        exact = [(p.encode(), label) for p, label in phrases]
        fuzzy = [Notice.of(*n) for n in notices]
        return lambda text: _scan(text, exact, fuzzy)

    columns = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
               "notices array<struct<label: string, start: long, end: long, first_word: long, words: long, edits: long>>")
    return per_text(docs, columns, make, id_col, text_col).withColumnRenamed("id", id_col)
