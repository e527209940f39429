"""Importance resampling towards a target distribution, with an exact cutoff by weighted median of medians.

1. Words of all texts are counted in hashed buckets, for the documents and for the target texts; a bucket's gain is the
   logarithm of its smoothed frequency in the target over that in the documents, in whole thousandths.
2. A text's weight is the floored mean of the gains over its words, looked up in the array of gains; its key is the
   weight plus Gumbel noise made from a hash of its id, so that the highest keys are a draw without replacement.
3. The cutoff key is selected exactly: every partition gives the median of its remaining keys, the median of these
   weighted by the remaining sizes is the pivot, and counting the keys above it discards one side of all partitions.
   A side holds a quarter of what remains at least, so rounds grow with the logarithm of the rows. Only medians and
   counts, a row per partition and round, reach the driver.
4. The winners alone are sorted and numbered.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators._common import positions
from .license_scan import normalised
from .tables import per_text, stage

#: Rounds after which the remaining keys are written again, so that later rounds read only these.
REWRITE_ROUNDS = 4


def feature_counts(text: str | None, longest: int = 1) -> Counter:
    """Runs of 1 to ``longest`` consecutive words (UTF-8, joined by one space), with repeats."""
    words = normalised(text).split()
    out = Counter(words)
    for n in range(2, longest + 1):
        out.update(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return out


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> dict[int, int]:
    """Features per bucket over all texts: counted within tasks, summed by a shuffle; at most ``buckets`` rows return."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                for feature, n in feature_counts(text, longest).items():
                    total[crc32(feature) % buckets] += n
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains_of(held: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) per bucket, in doubles."""
    all_s, all_t = sum(held.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_s / ((held.get(b, 0) + 1.0) * all_t)))
            for b in range(buckets)]


def weigh(docs: DataFrame, gains: list[int], longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight): the floored mean of the gains over a text's features (none: 0)."""
    gain, buckets = np.array(gains, np.int64), len(gains)

    def of(text: str | None) -> tuple:
        counts = feature_counts(text, longest)
        n = counts.total()
        places = np.fromiter((crc32(f) % buckets for f in counts), np.int64, len(counts))
        total = int(gain[places] @ np.fromiter(counts.values(), np.int64, len(counts))) if n else 0
        words = n if longest == 1 else sum(c for f, c in counts.items() if b" " not in f)
        return n, words, total // n if n else 0

    return per_text(docs, "n_features long, n_words long, weight long", lambda: of, id_col, text_col)


def noise(ident: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h being the first 8 hex digits of sha256("seed:id")."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _sides(pivot: tuple[int, int] | None):
    """Per partition: size and median of the keys before the pivot, size and median of those after it, copies of it.

    Keys are (score, id) in the order of the draw: scores falling, then ids rising. Without a pivot all keys count as
    being after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        score = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
        ident = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
        if pivot is None:
            before = same = np.zeros(len(score), bool)
        else:
            before = (score > pivot[0]) | ((score == pivot[0]) & (ident < pivot[1]))
            same = (score == pivot[0]) & (ident == pivot[1])
        row = {"copies": int(same.sum())}
        for name, side in (("before", before), ("after", ~before & ~same)):
            at = np.flatnonzero(side)
            row[name] = len(at)
            if len(at):
                middle = at[np.lexsort((ident[at], -score[at]))[len(at) // 2]]
                row |= {f"{name}_score": int(score[middle]), f"{name}_id": int(ident[middle])}
        yield pa.RecordBatch.from_pylist([row], schema=SIDE)
    return run


SIDE = pa.schema([(n, pa.int64()) for n in (
    "copies", "before", "before_score", "before_id", "after", "after_score", "after_id")])


def weighted_median(medians: list[tuple[int, tuple[int, int]]]) -> tuple[int, int]:
    """The first key, in the order of the draw, up to which half of the sizes lie."""
    ordered = sorted(medians, key=lambda m: (-m[1][0], m[1][1]))
    half, seen = sum(size for size, _ in ordered) / 2, 0
    for size, key in ordered:
        seen += size
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, draw: int) -> tuple[int, int] | None:
    """The ``draw``-th key (score, id) in the order of the draw: scores falling, then ids rising; None for draw < 1.

    ``keys``: (score long, id long) without nulls, at least ``draw`` of them, from a written table."""
    if draw < 1:
        return None
    columns, left, pivot, rounds = ", ".join(f"{n} long" for n in SIDE.names), draw, None, 0
    while True:
        rows = keys.select("score", "id").mapInArrow(_sides(pivot), columns).collect()  # one row per partition
        before, same = sum(r.before for r in rows), sum(r.copies for r in rows)
        if pivot is not None and before < left <= before + same:
            return pivot
        side = "before" if left <= before else "after"
        if side == "after":
            left -= before + same
        if pivot is not None:
            ahead = (F.col("score") > pivot[0]) | ((F.col("score") == pivot[0]) & (F.col("id") < pivot[1]))
            behind = (F.col("score") < pivot[0]) | ((F.col("score") == pivot[0]) & (F.col("id") > pivot[1]))
            keys = keys.filter(ahead if side == "before" else behind)
        pivot = weighted_median([(r[side], (r[f"{side}_score"], r[f"{side}_id"])) for r in rows if r[side]])
        rounds += 1
        if rounds % REWRITE_ROUNDS == 0:
            keys = stage(keys, "draw-keys")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 10, least_words: int = 20, buckets: int = 10000,
             longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_features, weight, score, rank), all long.

    Words are runs of digits, a-z (A-Z lower-cased) and all code points beyond ASCII; features are runs of 1 to
    ``longest`` of them. Of the N rows with at least ``least_words`` words the floor(per_cent N / 100) highest scores
    are drawn, ties to the smaller id, and numbered from 1 in that order; other rows have a null rank. Null and empty
    texts have no features and weight 0. Rows with a null id count among the texts, but have a null score, are not
    among the N and are never drawn. Rows repeated with one id and text are rows of their own with equal keys; which
    of them is drawn, if not all are, makes no difference to the result. Without target texts all gains follow from
    the smoothing alone. An empty table gives an empty result; further columns are ignored, whatever their names.

    Ids must be whole numbers."""
    gains = gains_of(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_col), buckets)
    weighed = weigh(docs, gains, longest, id_col, text_col)
    scored = stage(weighed.withColumn("id", F.col("id").cast("long")).withColumn(
        "score", (F.col("weight") + noise(F.col("id"), seed)).cast("long")), "draw-scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    draw = scored.filter(able).count() * per_cent // 100
    cutoff = cutoff_key(scored.filter(able).select("score", "id"), draw)
    won = F.lit(False) if cutoff is None else able & (
        (F.col("score") > cutoff[0]) | ((F.col("score") == cutoff[0]) & (F.col("id") <= cutoff[1])))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    # Copies of the cutoff key itself can be more than are drawn.
    ranked = positions(scored.filter(won), [F.desc("score"), F.asc("id")], name="rank")
    rank = F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank")
    rest = scored.filter(~F.coalesce(won, F.lit(False)))
    return ranked.select(*columns, rank).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
