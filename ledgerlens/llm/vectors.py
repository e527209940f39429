"""Integer vectors in blocks, for operators that hold a set of queries against all rows.

A block is one row: ids, labels, and the matrix of whole numbers, row after row. Query
blocks and candidate blocks meet by two equi-joins on block numbers (``grid``), so that no vector is
ever paired by Spark and a task holds one block of either kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import stage

LONG_MAX, LONG_MIN = 2 ** 63 - 1, -2 ** 63
CELLS = (np.int8, np.int16, np.int32, np.int64)
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()),
                   ("size", pa.int32()), ("cells", pa.binary())])
#: What a pair of blocks brings to a task.
SIDES = [f"{side}_{name}" for side in "qc" for name in BLOCK.names]


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, factor: int, label: Column | None = None) -> DataFrame:
    """(id long, v array<long>, and label long if asked for) of the rows that take part, v being floor(factor * x) in
    doubles.

    Rows take no part if the id, the vector or (if asked for) the label is null, or a component is null or not
    finite. Equal rows are one row. Components beyond a long are its ends."""
    vec = F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"),
            F.transform(vec, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))).alias("v")]
    asked = F.col(f"`{id_col}`").isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False))
    if label is not None:
        cols.append(label.cast("long").alias("label"))
        asked = asked & label.isNotNull()
    return rows.filter(asked).select(*cols).distinct()


def _small(cells: np.ndarray) -> np.ndarray:
    """The cells in the smallest whole-number type that holds them."""
    low, high = (int(cells.min()), int(cells.max())) if cells.size else (0, 0)
    return cells.astype(next(t for t in CELLS if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(vectors: list) -> np.ndarray:
    """Vectors as one matrix; shorter ones end in zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(block, ids, labels, width, size, cells) written to the shared folder: the vectors dealt evenly into blocks of
    about ``rows`` (fewer than twice as many), in the order of their ids; size is the bytes of a cell."""
    labelled = "label" in vectors.columns
    number = max(1, math.ceil(vectors.count() / rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, labels, vecs = [], [], []

        def block(n: int) -> pa.RecordBatch:
            order = np.argsort(np.array(ids[:n], np.int64), kind="stable")
            own = [np.array(x[:n], np.int64)[order].tobytes() for x in (ids, labels if labelled else [0] * n)]
            matrix = _small(_matrix(vecs[:n])[order])
            values = [part + made * number, *own, matrix.shape[1], matrix.itemsize, matrix.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, values))], schema=BLOCK)

        for b in batches:
            ids += b["id"].to_pylist()
            vecs += b["v"].to_pylist()
            labels += b["label"].to_pylist() if labelled else []
            while len(ids) >= 2 * rows:
                yield block(rows)
                ids, labels, vecs, made = ids[rows:], labels[rows:], vecs[rows:], made + 1
        if ids:
            yield block(len(ids))

    columns = "block long, ids binary, labels binary, width int, size int, cells binary"
    return stage(vectors.repartition(number).mapInArrow(pack, columns), f"{name}-blocks")


def grid(asked: DataFrame, held: DataFrame, segments: int = 1) -> DataFrame:
    """Every query block beside every candidate block, for each segment number: columns q_* and c_* and ``segment``.

    A stated query set against all rows, in blocks: every candidate block gets the numbers of the query blocks, and
    the blocks come by equi-joins on the two numbers."""
    last = asked.agg(F.max("block")).first()[0]
    asking = F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))  # a number without a block finds none
    pairs = held.select(F.col("block").alias("c_block"), F.explode(asking).alias("q_block"))
    return beside(pairs.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))), asked, held)


def beside(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs`` (q_block, c_block, ...) with the columns of both blocks."""
    q = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    h = held.select(*[F.col(c).alias(f"c_{c}") for c in held.columns])
    return pairs.join(q, "q_block").join(h, "c_block")


def numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64)


def cells(row: dict, side: str) -> np.ndarray:
    """The matrix of a block ("q" or "c") of a pair, as longs."""
    kind = next(t for t in CELLS if np.dtype(t).itemsize == row[f"{side}_size"])
    return np.frombuffer(row[f"{side}_cells"], kind).reshape(-1, row[f"{side}_width"]).astype(np.int64) if row[
        f"{side}_width"] else np.zeros((len(numbers(row[f"{side}_ids"])), 0), np.int64)


def bound(q: np.ndarray, c: np.ndarray) -> int:
    """No inner product of rows of q and c exceeds this."""
    if not q.size or not c.size:
        return 0
    most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (q, c)]
    return most[0] * most[1] * min(q.shape[1], c.shape[1])


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of rows of q and c, exactly: in floats as long as every sum is a whole number that these
    hold, else in Python's integers."""
    width, most = min(q.shape[1], c.shape[1]), bound(q, c)
    q, c = q[:, :width], c[:, :width]
    if most < 2 ** 53:
        kind = np.float32 if most < 2 ** 24 else np.float64
        return q.astype(kind) @ c.astype(kind).T
    return q.astype(object) @ c.astype(object).T


def paired(q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray, rows: int = 65536) -> np.ndarray:
    """Inner products of the rows at_q of q with the rows at_c of c, exactly, as longs (beyond a long: its ends)."""
    width, most = min(q.shape[1], c.shape[1]), bound(q, c)
    kind = np.float32 if most < 2 ** 24 else np.int64 if most < 2 ** 63 else object
    q, c, out = q[:, :width].astype(kind), c[:, :width].astype(kind), np.zeros(len(at_q), np.int64)
    for i in range(0, len(at_q), rows):
        a, b = q[at_q[i:i + rows]], c[at_c[i:i + rows]]
        out[i:i + rows] = as_longs((a * b).sum(axis=1) if kind is object else np.einsum("ij,ij->i", a, b))
    return out


def as_longs(values: np.ndarray) -> np.ndarray:
    if values.dtype != object:
        return values.astype(np.int64)
    return np.array([min(max(int(x), LONG_MIN), LONG_MAX) for x in values.ravel()], np.int64).reshape(values.shape)


def top(order_by: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group; ``order_by``: keys, the most important first, ascending."""
    order = np.lexsort([*order_by[::-1], group])
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def map_pairs(rows: DataFrame, columns: str, of: Callable[[dict], list], names: list[str]) -> DataFrame:
    """``of(a row of the named columns)`` gives the columns, in the order of the schema, of that row's output rows."""
    arrow = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                values = of({n: b[n][i].as_py() for n in names})
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(values, arrow)], schema=arrow)

    return rows.select(*names).mapInArrow(run, columns)
