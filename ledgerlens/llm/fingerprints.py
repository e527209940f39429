"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

Terms are runs of ``shingle`` words. Every term's XXH64 votes with its weight, 1 + ln(frequency),
for (bit set) or against (not set) each of 64 bits; the sign of the sum is the fingerprint's bit. The
share of differing bits estimates the angle of two weighted term vectors, and its cosine is the likeness.

For a search the 64 bits are cut into blocks. Fingerprints within r bits agree in at least
blocks - r of them, so for each choice of that many blocks there is a table keyed by these blocks'
bits (the fingerprint permuted to start with them); every table is probed and the whole distance checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .hashing import pack_bits, shingle_hashes, words_of
from .tables import per_text, salted_lookup, stage

BITS = 64


def weighted_fingerprint(text: str | None, shingle: int = 2) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for a text without words."""
    hashes = shingle_hashes(words_of(text), shingle)
    if not len(hashes):
        return 0
    terms, times = np.unique(hashes, return_counts=True)
    weights = 1.0 + np.log(times)
    votes = np.zeros(BITS)
    for i in range(0, len(terms), 4096):  # blocks bound the memory
        block = terms[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += weights[i:i + 4096] @ np.unpackbits(block, axis=1)
    return pack_bits(2.0 * votes > weights.sum())


def likeness(a: int, b: int) -> float:
    """Cosine of the angle that the differing bits stand for, from 0 (a right angle or more) to 1."""
    differ = ((a ^ b) & (2**BITS - 1)).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / BITS))) if differ < BITS // 2 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, shingle: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per input row; null texts are empty."""
    return per_text(docs, "fp long", lambda: lambda text: (weighted_fingerprint(text, shingle),), id_col, text_col)


_RESULT = ["n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
_RESULT_SCHEMA = "n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _result(text: str, fp: int, following: str, following_fp: int, shingle: int) -> tuple:
    new = edited(text, following)
    new_fp = weighted_fingerprint(new, shingle)
    return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp,
            likeness(fp, new_fp), likeness(fp, following_fp))


def compare_with_next(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """One row per input row: (doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next).

    The next document has the next smaller doc_id; after the last comes the first. Null texts are
    empty, null ids come last. Texts under one id follow each other by their hash; rows repeated with
    one id and text are one document, with as many result rows. A single document follows itself. An empty
    table gives an empty result; further columns are ignored.

    One range shuffle puts the documents in order. Tasks stream through their range, holding two
    documents; the first and the last of each range are then matched across ranges."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.desc_nulls_last("id"), F.asc("version")]
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    in_order = source.repartitionByRange(*order).sortWithinPartitions(*order)

    schema = StructType([source.schema["id"], *StructType.fromDDL(
        f"copies long, range int, edge string, text string, own_fp long, {_RESULT_SCHEMA}")])
    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # [id, version, text, fp, copies]
        for b in batches:
            out = []
            for ident, version, body in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] == ident and held[1] == version:
                    held[4] += 1
                    continue
                fp = weighted_fingerprint(body, shingle)
                if held is None:
                    out.append((ident, 0, part, "first", body, fp) + (None,) * 6)
                else:
                    out.append((held[0], held[4], part, None, None, None) + _result(held[2], held[3], body, fp, shingle))
                held = [ident, version, body, fp, 1]
            yield batch(out)
        if held:
            yield batch([(held[0], held[4], part, "last", held[2], held[3]) + (None,) * 6])

    rows = stage(in_order.mapInArrow(run, schema), "compared")
    # One row per range: its number is bounded by the number of shuffle partitions.
    ranges = rows.filter("edge = 'first'").select("range")
    everywhere = Window.orderBy("range")
    ranges = ranges.select("range", F.coalesce(
        F.lead("range").over(everywhere),
        F.first("range").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_range"))
    first = rows.filter("edge = 'first'").select(
        F.col("range").alias("next_range"), F.col("text").alias("next_text"), F.col("own_fp").alias("next_fp"))
    last = rows.filter("edge = 'last'").select("id", "copies", "range", "text", "own_fp")
    last = last.join(ranges, "range").join(first, "next_range").select("id", "copies", "text", "own_fp", "next_text", "next_fp")

    end_schema = StructType([source.schema["id"], *StructType.fromDDL(f"copies long, {_RESULT_SCHEMA}")])
    end_arrow = to_arrow_schema(end_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_result(*r, shingle) for r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            values = [pa.array([r[i] for r in done], f.type) for i, f in enumerate(list(end_arrow)[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *values], schema=end_arrow)

    ends = last.mapInArrow(finish, end_schema)
    whole = rows.filter("edge is null").select("id", "copies", *_RESULT).unionByName(ends)
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return whole.select(F.col("id").alias("doc_id"), *_RESULT)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(BITS - b, b - a) for a, b in zip(edges, edges[1:])]


def _bits(fp: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(q, fp) for every fingerprint of ``prints`` (column fp, distinct) within ``radius`` bits of
    one of ``queries`` (column q, distinct), itself included; each pair once."""
    cuts, lead = _blocks(blocks), blocks - radius
    if lead < 1:
        raise ValueError("blocks must be more than radius")
    tables = list(combinations(range(blocks), lead))

    def keyed(df: DataFrame, col: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *[_bits(F.col(col), cuts[b]) for b in chosen]).alias("key"))
                for t, chosen in enumerate(tables)]
        return df.select(col, F.explode(F.array(*keys)).alias("k")).select(col, "k.table", "k.key")

    q, t = keyed(queries, "q").alias("a"), keyed(prints, "fp").alias("b")
    differ = F.col("a.q").bitwiseXOR(F.col("b.fp"))
    agree = [_bits(differ, c) == 0 for c in cuts]
    # A pair counts in the table of its first agreeing blocks only.
    first = F.lit(False)
    for n, chosen in enumerate(tables):
        here = F.col("a.table") == n
        for block in range(chosen[-1] + 1):
            here = here & (agree[block] if block in chosen else ~agree[block])
        first = first | here
    found = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key"))
    return q.join(t, found & (F.bit_count(differ) <= radius) & first).select("q", "fp")


def count_neighbours(rows: DataFrame, is_query: Column, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``n_near``: for the query rows, the number of other rows whose fingerprint
    is within ``radius`` bits; null elsewhere. Equal fingerprints are searched once."""
    prints = stage(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.max(is_query).alias("asked")), "distinct-prints")
    pairs = neighbours(prints.filter("asked").select(F.col("fp").alias("q")), prints.select("fp"), radius, blocks)
    near = pairs.join(prints.select("fp", "rows"), "fp").groupBy("q").agg((F.sum("rows") - 1).alias("n_near"))
    out = salted_lookup(rows, near.withColumnRenamed("q", "fp"), "fp", "doc_id")
    return out.withColumn("n_near", F.when(is_query, F.col("n_near")))
