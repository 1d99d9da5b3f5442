"""The best rows of each request, for any number of requests: blocks of requests times batches of rows.

A few requests travel to the tasks that read the rows, in one pass without a shuffle. Many are packed into
blocks; each block meets each tile of packed rows in one task, which holds the block's requests
and streams the tile's rows past them. Either way a task keeps, for each request, its best rows so
far and the cost that a row must not exceed to be among them, and only those rows leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import indexed
from .session import cut

#: Requests that travel to all tasks (also at most FEW_BYTES), requests of a block, rows of a packed batch, cells of one matrix of costs.
FEW, FEW_BYTES, BLOCK_ASKS, BATCH_ROWS, CELLS = 512, 16 << 20, 1024, 4096, 1 << 21


@dataclass(frozen=True)
class Scorer:
    """How rows are priced: ``rows`` and ``asks`` turn tables into whatever ``cost`` takes to tell requests by rows, inf for never."""

    rows: Callable[[pa.RecordBatch], object]
    asks: Callable[[pa.Table], object]
    cost: Callable[[object, object, slice], np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(pa.compute.list_flatten(column), dtype=float).reshape(len(column), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)


class Best:
    """The cheapest rows of each request among the rows seen; with a group, the cheapest row of each of the cheapest groups."""

    def __init__(self, asks: pa.Table, scorer: Scorer, k: int | None, group: str | None):
        self.names, self.scorer, self.group = asks.column("ask").combine_chunks(), scorer, group
        self.asks = scorer.asks(asks)
        self.k = np.full(len(asks), k, np.int64) if k is not None else np.asarray(asks.column("k").combine_chunks(), dtype=np.int64)
        self.least = np.where(self.k > 0, np.inf, -np.inf)
        self.held = pd.DataFrame({"ask": np.zeros(0, np.int64), "cost": np.zeros(0), "id": np.zeros(0, np.int64), "group": np.zeros(0, object)})

    def see(self, batch: pa.RecordBatch) -> None:
        rows, ids = self.scorer.rows(batch), np.asarray(batch.column(batch.schema.get_field_index("id")))
        groups = batch.column(batch.schema.get_field_index(self.group)).to_pandas().to_numpy(dtype=object) if self.group else None
        wide = max(1, CELLS // max(1, len(self.k)))
        for at in range(0, len(ids), wide):
            part = slice(at, min(len(ids), at + wide))
            cost = np.round(self.scorer.cost(self.asks, rows, part), 12)
            limit = np.minimum(self.least, self._kth(cost, None if groups is None else groups[part]))
            ask, row = np.nonzero((cost <= limit[:, None]) & (cost < np.inf))
            if len(ask):
                more = pd.DataFrame({"ask": ask, "cost": cost[ask, row], "id": ids[part][row], "group": groups[part][row] if self.group else None})
                self._keep(pd.concat([self.held, more.astype({"group": object})], ignore_index=True) if len(self.held) else more)

    def _kth(self, cost: np.ndarray, groups: np.ndarray | None) -> np.ndarray:
        """No row above this cost of one matrix can be wanted."""
        if groups is not None:
            code, _ = pd.factorize(groups, use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            cost = np.minimum.reduceat(cost[:, order], np.flatnonzero(np.diff(code[order], prepend=-1)), axis=1)
        limit = np.full(len(cost), np.inf)
        for k in np.unique(self.k):
            if 0 < k < cost.shape[1]:
                mine = self.k == k
                limit[mine] = np.partition(cost[mine], k - 1, axis=1)[:, k - 1]
        return limit

    def _keep(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["ask", "cost", "id"], kind="stable")
        if self.group:
            rows = rows[~rows.duplicated(["ask", "group"])]
        ask = rows["ask"].to_numpy()
        place = np.arange(len(ask)) - np.searchsorted(ask, ask)
        self.held = rows[place < self.k[ask]]
        last = place == self.k[ask] - 1
        self.least[ask[last]] = rows["cost"].to_numpy()[last]

    def told(self) -> pa.RecordBatch:
        columns = [self.names.take(pa.array(self.held["ask"])), pa.array(self.held["cost"].to_numpy(dtype=float)), pa.array(self.held["id"].to_numpy(dtype=np.int64))]
        if self.group:
            columns.append(pa.array(self.held["group"].to_list(), pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["ask", "cost", "id", "group"][:len(columns)])


def _sent(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _packed(df: DataFrame, most: int) -> DataFrame:
    """Rows as blobs of at most ``most`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield pa.RecordBatch.from_arrays([pa.array([_sent(batch.slice(at, most))], pa.binary())], ["data"])

    return df.mapInArrow(run, "data binary")


def best_rows(rows: DataFrame, asks: DataFrame, scorer: Scorer, k: int | None = None, group: str | None = None, few: int = FEW, block: int = BLOCK_ASKS) -> DataFrame:
    """``ask, cost, id[, group], place``: the ``k`` cheapest rows (``id`` long, and what the scorer reads) of every request.

    ``asks`` has a unique ``ask``, what the scorer reads, and ``k`` (long) where no number is given. With ``group``, a
    string column of the rows, only the cheapest row of a group counts. Equal costs (to 12 places) go by id.
    """
    kind, spark = dict(asks.dtypes)["ask"], rows.sparkSession
    schema = f"ask {kind}, cost double, id long" + (", group string" if group else "")
    first = asks.limit(few + 1).toArrow()
    if len(first) <= few and first.nbytes <= FEW_BYTES:
        if not len(first):
            return spark.createDataFrame([], schema + ", place int")
        sent = _sent(first.combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(_read(sent), scorer, k, group)
            for batch in batches:
                if batch.num_rows:
                    best.see(batch)
            if len(best.held):
                yield best.told()

        found = rows.mapInArrow(run, schema)
    else:
        found = _in_blocks(rows, asks, scorer, k, group, block, schema)
    if group:
        found = found.groupBy("ask", "group").agg(F.min(F.struct("cost", "id")).alias("_b")).select("ask", "_b.cost", "_b.id", "group")
    if k is None:
        found = found.join(asks.select("ask", F.col("k").alias("_k")), "ask")
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy("cost", "id")))
    return placed.filter(F.col("place") <= (F.lit(k) if k is not None else F.col("_k"))).drop("_k")


def _in_blocks(rows: DataFrame, asks: DataFrame, scorer: Scorer, k: int | None, group: str | None, block: int, schema: str) -> DataFrame:
    blocks = cut(indexed(_packed(asks, block), [F.xxhash64("data")], "block"))
    packed = cut(_packed(rows, BATCH_ROWS))
    n_blocks, n_packed = blocks.count(), packed.count()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks)
    tiles = max(1, min(n_packed, 4 * tasks // n_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.select("block", each(tiles).alias("tile"), F.lit(0).alias("kind"), "data")
    right = packed.withColumn("tile", F.pmod(F.xxhash64("data"), F.lit(tiles))).select(
        each(n_blocks).alias("block"), "tile", F.lit(1).alias("kind"), "data")
    met = left.unionByName(right).repartition(tasks, "block", "tile").sortWithinPartitions("block", "tile", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if kind == 0:
                    if best is not None and len(best.held):
                        yield best.told()
                    best = Best(_read(data.as_py()), scorer, k, group)
                else:
                    for part in _read(data.as_py()).to_batches():
                        best.see(part)
        if best is not None and len(best.held):
            yield best.told()

    return met.select("kind", "data").mapInArrow(run, schema)
