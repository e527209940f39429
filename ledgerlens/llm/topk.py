"""Exact top-k search by inner product, by a three-phase uniform threshold.

A vector's dimensions are cut into m segments; a node is one segment of one block of candidates and knows the score of
every candidate over its own dimensions only.

1. Every node gathers, per query, the list of its ``depth`` best local scores. The whole scores of what is listed are
   resolved, and the k-th best of a query is its cutoff: k candidates reach it, so no worse one can be in the result.
2. The cutoff goes to all nodes with the query blocks. A candidate that reaches it has a local score of at least
   cutoff / m on one node, so each node sends all entries from there on: these are sufficient.
3. The scores that the entries lack are resolved exactly, and the k best stay, ties to the smaller id.

Lists and entries travel packed, one row per query block and node, never as a row per pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage
from .vectors import LONG_MIN, SIDES, beside, blocks, cells, grid, inner, map_pairs, numbers, paired, top, whole_vectors

ENTRIES = "q_block long, c_block long, places binary"
FOUND = "q_block long, query_id long, vec_id long, score long"


def _segment(matrix: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """A segment's dimensions, from 0."""
    cuts = [matrix.shape[1] * i // segments for i in range(segments + 1)]
    return matrix[:, cuts[segment]:cuts[segment + 1]]


def _local_scores(row: dict, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Local scores of a node, query by candidate, and which candidates are the query's own rows."""
    q, c = cells(row, "q"), cells(row, "c")
    width = max(q.shape[1], c.shape[1])  # the shorter ones end in zeros, and both are cut alike
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    own = numbers(row["q_ids"])[:, None] == numbers(row["c_ids"])[None, :]
    return inner(_segment(q, row["segment"], segments), _segment(c, row["segment"], segments)), own


def _entries(row: dict, chosen: np.ndarray) -> list:
    return [[row["q_block"]], [row["c_block"]], [np.flatnonzero(chosen).tobytes()]]


def _lists(depth: int, segments: int):
    """Phase 1: the places of the ``depth`` best local scores of each query."""
    def of(row: dict) -> list:
        scores, own = _local_scores(row, segments)
        chosen = ~own
        if scores.shape[1] > depth + 1:  # one more, as a query's own row may be among them
            best = np.argpartition(scores, scores.shape[1] - depth - 1, axis=1)[:, -depth - 1:]
            listed = np.zeros(scores.shape, bool)
            np.put_along_axis(listed, best, True, axis=1)
            chosen &= listed
        return _entries(row, chosen)
    return of


def _sufficient(segments: int):
    """Phase 2: the places of all local scores that reach the query's cutoff / m."""
    def of(row: dict) -> list:
        scores, own = _local_scores(row, segments)
        cutoffs = numbers(row["cutoffs"])
        least = cutoffs // segments + (cutoffs % segments > 0)  # scores are whole numbers
        if scores.dtype != object:  # whole numbers that this type of float holds exactly
            most = int(2 / np.finfo(scores.dtype).eps)
            least = np.clip(least, -most, most).astype(scores.dtype)
        reached = (scores >= least[:, None]) | (cutoffs == LONG_MIN)[:, None]
        return _entries(row, reached.astype(bool) & ~own)
    return of


def _resolve(k: int):
    """Whole scores of the entries of one query block and one candidate block; the k best of each query."""
    def of(row: dict) -> list:
        q_ids, c_ids = numbers(row["q_ids"]), numbers(row["c_ids"])
        places = np.unique(np.concatenate([np.zeros(0, np.int64), *map(numbers, row["places"])]))
        at_q, at_c = np.divmod(places, max(1, len(c_ids)))
        scores = paired(cells(row, "q"), cells(row, "c"), at_q, at_c)
        # Rows of one id and one vector are one row; other rows of that id count one by one.
        best = top([-1 - scores, c_ids[at_c]], at_q, k)
        return [np.full(len(best), row["q_block"]), q_ids[at_q[best]], c_ids[at_c[best]], scores[best]]
    return of


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, asked: DataFrame, k: int = 20, factor: int = 64, depth: int | None = None, segments: int = 2,
          query_rows: int = 1024, block_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``asked`` the k rows of ``vectors`` with the highest inner
    products of floor(factor * x), ties to the smaller id; all of them, if fewer.

    Candidates are all rows with another id than the query's. Rows with a null id or vector, or with a null or
    non-finite component, take no part, as query or as candidate. Equal rows (id and vector) are one; a query id with
    several vectors has the k best over all of them. Vectors of different lengths meet as if the shorter ended in
    zeros (an empty one scores 0 everywhere). Scores beyond a long count as its ends. Empty tables give an empty
    result; further columns are ignored, whatever their names. ``depth`` (4 k by default), ``segments`` and the
    block sizes change the work, never the result."""
    if k < 1 or segments < 1:
        raise ValueError("k and segments must be at least 1")
    depth = max(k, depth or 4 * k)
    held = blocks(whole_vectors(vectors, id_col, vec_col, factor), block_rows, "topk-held")
    queries = blocks(whole_vectors(asked, id_col, vec_col, factor), query_rows, "topk-asked")

    def resolved(entries: DataFrame) -> DataFrame:
        together = entries.groupBy("q_block", "c_block").agg(F.collect_list("places").alias("places"))  # one per segment
        return map_pairs(beside(together, queries, held), FOUND, _resolve(k), [*SIDES, "places"])

    nodes = grid(queries, held, segments)
    listed = stage(map_pairs(nodes, ENTRIES, _lists(depth, segments), [*SIDES, "segment"]), "topk-lists")
    known = stage(resolved(listed), "topk-known")
    least = _best(known, k).groupBy("q_block", "query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(LONG_MIN).alias("cutoff"))
    # A block's cutoffs in the order of its ids; a query without candidates has none.
    per_block = least.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "cutoff"))).alias("least"))
    per_block = queries.select("block", "ids").join(per_block, queries["block"] == F.col("q_block"), "left")
    cutoffs = map_pairs(per_block, "q_block long, cutoffs binary", _aligned, ["block", "ids", "least"])
    sent = map_pairs(nodes.join(stage(cutoffs, "topk-cutoffs"), "q_block"), ENTRIES, _sufficient(segments), [*SIDES, "segment", "cutoffs"])
    found = resolved(stage(sent, "topk-entries"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _aligned(row: dict) -> list:
    least = dict(row["least"] or {})
    return [[row["block"]], [np.array([least.get(i, LONG_MIN) for i in numbers(row["ids"]).tolist()], np.int64).tobytes()]]
