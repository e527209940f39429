"""Hard-negative mining with exact scores by the method of the Four Russians.

An anchor's components are taken in groups of eight dimensions; a table holds the sum of every subset of a group (256
sums). Candidates are held as bit planes: byte (p, g) of a candidate has bit p of the two's complement of its eight
components in group g. The inner product is then read off without a multiplication: the table entries that the bytes of a
plane select are added up over the groups, and the planes are joined from the highest (the sign's, counted negative)
down by doubling and adding.

Two passes over (anchor block, candidate block): the first gives each anchor's positives, the second the negatives
within each positive's margins. Only the best few of a block leave a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage
from .vectors import SIDES, as_longs, blocks, bound, cells, grid, map_pairs, numbers, top, whole_vectors

GROUP = 8
POSITIVES = "q_block long, anchor_id long, positive_id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Array (groups, 256, anchors): the sum of the components of a group that are set in a byte (first dimension:
    lowest bit), by doubling: subsets with dimension d are those without it, plus its component."""
    groups = -(-anchors.shape[1] // GROUP)
    padded = np.pad(anchors, ((0, 0), (0, groups * GROUP - anchors.shape[1]))).astype(kind)
    out = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for g in range(groups):
        for d in range(GROUP):
            out[g, 1 << d:2 << d] = out[g, :1 << d] + padded[:, g * GROUP + d]
    return out


def bit_planes(candidates: np.ndarray) -> np.ndarray:
    """Bytes (planes, groups, candidates) of the two's complement, the sign's plane last; as many planes as the largest
    component needs."""
    groups = -(-candidates.shape[1] // GROUP)
    padded = np.pad(candidates, ((0, 0), (0, groups * GROUP - candidates.shape[1])))
    low, high = (int(padded.min()), int(padded.max())) if padded.size else (0, 0)
    planes = max(high.bit_length(), (-1 - low).bit_length() if low < 0 else 0) + 1
    out = np.zeros((planes, groups, len(padded)), np.uint8)
    for p in range(planes):
        bits = ((padded >> p) & 1).astype(np.uint8).reshape(len(padded), groups, GROUP)
        out[p] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray, rows: int = 2048) -> np.ndarray:
    """All inner products (candidates x anchors), exactly, from lookups, additions and doublings."""
    width = min(anchors.shape[1], candidates.shape[1])
    anchors, candidates = anchors[:, :width], candidates[:, :width]
    most = bound(anchors, candidates)
    kind = np.int32 if most < 2 ** 29 else np.int64 if most < 2 ** 60 else object
    tables, planes = subset_sums(anchors, kind), bit_planes(candidates)
    out = np.zeros((len(candidates), len(anchors)), kind)
    for a in range(0, len(candidates), rows):
        total = out[a:a + rows]
        for p in range(len(planes) - 1, -1, -1):
            if p < len(planes) - 1:
                total += total
            for g, table in enumerate(tables):
                found = table[planes[p, g, a:a + rows]]
                if p == len(planes) - 1:
                    total -= found
                else:
                    total += found
    return out


def _positives(count: int):
    """The ``count`` best other rows of an anchor's label within one block."""
    def of(row: dict) -> list:
        q_ids, c_ids, score = numbers(row["q_ids"]), numbers(row["c_ids"]), as_longs(scores(cells(row, "q"), cells(row, "c")))
        same = (numbers(row["c_labels"])[:, None] == numbers(row["q_labels"])) & (c_ids[:, None] != q_ids)
        at_c, at_q = np.nonzero(same)
        found = score[at_c, at_q]
        best = top([-1 - found, c_ids[at_c]], at_q, count)
        return [np.full(len(best), row["q_block"]), q_ids[at_q[best]], c_ids[at_c[best]], found[best]]
    return of


def _negatives(count: int, low: int, high: int):
    """For each positive of the block's anchors the ``count`` best rows of other labels within its margins."""
    def of(row: dict) -> list:
        q_ids, c_ids, score = numbers(row["q_ids"]), numbers(row["c_ids"]), as_longs(scores(cells(row, "q"), cells(row, "c")))
        c_labels, q_labels = numbers(row["c_labels"]), numbers(row["q_labels"])
        out: list[list] = [[], [], [], [], []]
        asked: dict[int, list] = {}
        for p in row["positives"]:
            asked.setdefault(p["anchor_id"], []).append((p["positive_id"], p["score"]))
        for q in range(len(q_ids)):
            wanted = [(i, s, -(-low * s // 100), high * s // 100) for i, s in asked.get(int(q_ids[q]), [])]
            wanted = [w for w in wanted if w[2] <= w[3]]
            if not wanted:
                continue
            least, most = min(w[2] for w in wanted), max(w[3] for w in wanted)
            at = np.flatnonzero((c_labels != q_labels[q]) & (score[:, q] >= least) & (score[:, q] <= most))
            at = at[np.argsort(-score[at, q], kind="stable")]  # blocks are in the order of their ids
            falling = -score[at, q]
            for positive, value, a, b in wanted:
                first = int(np.searchsorted(falling, -b))
                chosen = at[first:min(first + count, int(np.searchsorted(falling, -a, side="right")))]
                for column, x in zip(out, ([int(q_ids[q])] * len(chosen), [positive] * len(chosen), [value] * len(chosen),
                                           c_ids[chosen].tolist(), score[chosen, q].tolist())):
                    column += x
        return out
    return of


def mine(rows: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90, factor: int = 256, anchor_rows: int = 256, block_rows: int = 8192, id_col: str = "vec_id",
         vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(factor * x). An anchor's positives are its ``positives`` best other rows of the
    same label, its negatives for each of them the ``negatives`` best rows of other labels whose score is from low to
    high per cent of the positive's; higher scores first, ties to the smaller id; all, if fewer. A positive with a
    negative score, or without rows in its margins, has none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows (id, label and
    vector) are one; other rows of an anchor's id are no positives of it, and an anchor id with several rows is mined
    over all of them. Vectors of different lengths meet as if the shorter ended in zeros. Scores beyond a long count as
    its ends. Empty tables give an empty result; further columns are ignored, whatever their names. Block sizes
    change the work, never the result."""
    whole = whole_vectors(rows, id_col, vec_col, factor, label)
    chosen = whole_vectors(rows.filter(anchors), id_col, vec_col, factor, label)
    held, asked = blocks(whole, block_rows, "mine-held"), blocks(chosen, anchor_rows, "mine-anchors")
    near = grid(asked, held)
    found = map_pairs(near, POSITIVES, _positives(positives), SIDES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    first = stage(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "mine-positives")
    # At most ``positives`` for each anchor of a block.
    wanted = first.groupBy("q_block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "score")).alias("positives"))
    found = map_pairs(near.join(wanted, "q_block"), NEGATIVES, _negatives(negatives, low, high), [*SIDES, "positives"])
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
