"""Packing documents into training sequences: shortest pack first over the length histogram.

Tasks tokenize whole documents and cut them into pieces of at most ``size`` tokens. The histogram of piece lengths
(at most ``size`` rows) is all that the packing needs: lengths are placed longest first, each into
the packs that are shortest so far and still have room, and only counts of equal packs (packing
patterns) are updated. Patterns are then joined back to the pieces by rank: the r-th piece of a
length takes the r-th place that the patterns have for it.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import salt_of, stage

SIZE = 2048
END_ID = 1
CACHE_CHUNKS = 300_000
BEYOND_LATIN = regex.compile("[^\\x00-\u024f]|\u0130")
#: White space of str.split that the tokenizer's pattern takes for punctuation.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The split pattern of the tokenizer's file (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: printable Latin-1 characters
    stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, without special tokens added.

    The tokenizer lower-cases and never joins characters across white space, so for Latin
    letters each chunk between white space is split by its pattern and encoded by the
    library's model once and remembered (a bounded memory per worker). Other texts, and those with
    text of the added tokens, go through the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.seen: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _word(self, word: str) -> bytes:
        got = self.seen.get(word)
        if got is None:
            letters = self.letters
            spelled = word if word.isascii() and word.isprintable() else "".join([letters[b] for b in word.encode()])
            got = self.seen[word] = array("I", [t.id for t in self.lib.model.tokenize(spelled)]).tobytes()
        return got

    def _plain(self, text: str) -> bool:
        if "<|" in text or any(c in text for c in ODD_SPACE):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return BEYOND_LATIN.search(text) is None

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self._plain(text):
            return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.lower().split()
        seen = self.seen
        if len(seen) > CACHE_CHUNKS:
            seen.clear()
        for c in set(chunks).difference(seen):
            words = WORDS.findall(c)
            seen[c] = self._word(c) if words == [c] else b"".join([self._word(w) for w in words])
        return b"".join([seen[c] for c in chunks])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """The worker's tokenizer of that file, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) per piece of the whole text's ids and the end id."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    columns = "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    schema = StructType([source.schema["id"], *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)
    end = array("I", [END_ID]).tobytes()
    wide = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        for b in batches:
            rows, of = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = tokenizer.ids(text) + end
                for at in range(0, len(data), wide):
                    part = data[at:at + wide]
                    row = (at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4)
                    rows.append(row + (np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else row)
                    of.append(i)
            values = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *values], schema=arrow)

    return source.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths longest first) that hold ``histogram[n]`` pieces of each length n.

    Lengths go longest first, each into the packs with the most room left if that is enough, else
    into new packs. Of equal packs only the count is kept; a group is split where fewer pieces than packs are
    left, so there are at most two patterns per length and group, however many documents."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by room left
    rooms: list[int] = []  # negative, as a heap
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if room == 0:
            full.append((count, pattern))
            return
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo and rooms and -rooms[0] >= length:
            room = -rooms[0]
            count, pattern = groups[room].pop()
            used = min(count, todo)
            if used < count:
                groups[room].append((count - used, pattern))
            if not groups[room]:
                del groups[room]
                heapq.heappop(rooms)
            put(room - length, used, pattern + (length,))
            todo -= used
        if todo:
            put(size - length, todo, (length,))
    return sorted(full + [g for rows in groups.values() for g in rows], key=lambda p: (p[1], p[0]), reverse=True)


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first_sequence, times, first_offset): pieces of the length with ranks low
    to high - 1 fill the pattern's sequences, ``times`` to each, from that offset on."""
    out, sequence, taken = [], 0, {}
    for count, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            low = taken.get(length, 0)
            taken[length] = high = low + count * times
            out.append((length, low, high, sequence, times, offset))
            offset += length * times
        sequence += count
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """Pieces with ``rank``, 0, 1, ... within each length, by id and start within hash parts, so that a
    length that many pieces share is numbered by many tasks."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", salt_of(spark, "id", "start"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy(F.asc_nulls_first("id"), "start", "doc_tokens", "ids_crc32")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place")).drop(
        "part", "first", "place")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    Every document is its token ids and the end id 1; documents longer than ``size`` are cut every
    ``size`` ids. Null and empty texts are the end id alone. Repeated rows, ties and null ids are
    packed as documents of their own; an empty table gives an empty result; further columns are ignored."""
    spark = docs.sparkSession
    rows = stage(pieces(docs, tokenizer_path, size, id_col, text_col, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``size`` rows
    table = places(shortest_pack_first(histogram, size))
    spans = spark.createDataFrame(table, "length long, low long, high long, first_sequence long, times long, first_offset long")
    r = F.col("rank") - F.col("low")
    # The pattern table is bounded by the number of lengths, not by the data.
    out = ranked(rows).join(F.broadcast(spans), "length").filter("rank >= low and rank < high")
    out = out.withColumn("sequence_id", F.col("first_sequence") + F.floor(r / F.col("times"))).withColumn(
        "offset", F.col("first_offset") + F.col("length") * (r % F.col("times")))
    cols = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["sequence_id", "offset"]
    return out.select(F.col("id").alias(id_col), *cols)
