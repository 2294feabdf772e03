"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component that gives all the same length, so the largest inner product is the smallest
distance. Each of several tables cuts Gaussian (2-stable) projections into cells; a query visits its own
bucket and perturbed ones in the order of estimated success, the squared distance to the cell. Candidates of
all tables merge and rank by exact double-precision products of the original vectors.

Buckets and the queries that visit them are split into blocks of bounded size, so a bucket with a third of all
vectors is many tasks and nothing is cut off. Queries that find fewer than k vectors are scanned against all.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored

TABLES, PROJECTIONS = 3, 4
#: Width of a cell in common lengths; wide cells suit data without clusters.
WIDTH = 2.5
PROBES = 14
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024

_MOVES = np.array(list(itertools.product((0, -1, 1), repeat=PROJECTIONS)))


class Hashing:
    """Projections of the lengthened vectors for each table; fixed by the dimension and the largest length."""

    def __init__(self, dimension: int, longest: float):
        rng = np.random.default_rng(3)
        self.longest, self.width = longest, WIDTH * longest
        raw = rng.standard_normal((TABLES, dimension + 1, PROJECTIONS))
        self.axes = np.stack([np.linalg.qr(a)[0] if dimension >= PROJECTIONS else a for a in raw]) * np.sqrt(dimension + 1)
        self.shift = rng.random((TABLES, PROJECTIONS)) * self.width

    def cells(self, x: np.ndarray, query: bool) -> np.ndarray:
        """table x row x projection: places in units of the cell width. Queries are scaled to the common length."""
        length = np.sqrt((x * x).sum(axis=1))
        if query:
            x, more = x * (self.longest / length)[:, None], np.zeros(len(x))
        else:
            more = np.sqrt(np.maximum(self.longest ** 2 - length ** 2, 0))
        full = np.column_stack([x, more])
        return (full[None] @ self.axes + self.shift[:, None]) / self.width

    def home(self, x: np.ndarray) -> np.ndarray:
        return _names(np.floor(self.cells(x, False)).astype(np.int64))

    def probes(self, x: np.ndarray) -> np.ndarray:
        """row x (tables * PROBES) bucket names, likeliest first in each table."""
        place = self.cells(x, True)
        own = np.floor(place)
        inside = place - own
        cost = np.stack([np.zeros_like(inside), inside, 1 - inside], axis=-1) ** 2  # of moves 0, -1, +1
        move = np.array([[{0: 0, -1: 1, 1: 2}[m] for m in moves] for moves in _MOVES])
        total = sum(cost[:, :, j, move[:, j]] for j in range(PROJECTIONS))
        order = np.argsort(total, axis=-1, kind="stable")[:, :, :PROBES]
        names = _names(own[:, :, None].astype(np.int64) + _MOVES[order])
        return names.transpose(1, 0, 2).reshape(len(x), -1)


def _names(cells: np.ndarray) -> np.ndarray:
    """A number for (table, cells), table on axis 0."""
    name = np.broadcast_to(np.arange(len(cells)).reshape(-1, *[1] * (cells.ndim - 2)), cells.shape[:-1]).astype(np.int64)
    for j in range(cells.shape[-1]):
        name = name * 1_000_003 + cells[..., j]
    return name


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _bucketed(hashing: Hashing, query: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), batch.num_rows)
            names = hashing.probes(x) if query else hashing.home(x).T
            row = np.repeat(np.arange(len(x)), names.shape[1])
            for lo in range(0, len(row), 20_000):
                part = row[lo:lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1)[lo:lo + 20_000]), batch.column(0).take(pa.array(part)),
                                                  batch.column(1).take(pa.array(part))], names=["bucket", "id", "x"])
    return run


def _best(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, x = (_matrix(t.column("x").combine_chunks(), t.num_rows) for t in (queries, rows))
            qid, xid = (t.column("id").to_numpy() for t in (queries, rows))
            near = q @ x.T
            near[qid[:, None] == xid] = -np.inf
            cut = np.partition(near, max(0, len(xid) - k), axis=1)[:, max(0, len(xid) - k)]
            slack = 1e-9 * (1 + np.abs(near).max(initial=0, where=np.isfinite(near)))
            for i in range(len(q)):
                at = np.flatnonzero((near[i] >= cut[i] - slack) & np.isfinite(near[i]))
                exact = (q[i] * x[at]).sum(axis=1)
                at = np.lexsort((xid[at], -exact))[:k], at
                out[0].append(np.full(len(at[0]), qid[i]))
                out[1].append(xid[at[1][at[0]]])
                out[2].append(exact[at[0]])
        joined = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)),
                         "score": pa.array(joined[2].astype(np.float64))})
    return run


def _search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact best k of each query among the rows of each bucket it visits, block by block."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    visits = queries.groupBy("bucket").agg(F.count("*").alias("m"))
    blocks = stored(sizes.join(visits, "bucket").select(
        "bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("mb")))
    own = rows.join(blocks, "bucket").withColumn("b", F.pmod(F.xxhash64("id"), "nb").cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select("bucket", "b", "c", "id", "x")
    ask = queries.join(blocks, "bucket").withColumn("c", F.pmod(F.xxhash64("id"), "mb").cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("bucket", "b", "c", "id", "x")
    key = ["bucket", "b", "c"]
    return ask.groupBy(key).cogroup(own.groupBy(key)).applyInArrow(_best(k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``rows`` (vec_id, embedding) found for each query.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
    dimension is not the commonest one, nor null ids. A query is never its own neighbour, by id. Ties go to the smaller vec_id;
    repeated ids count once. Other columns are ignored.
    """
    def usable(df: DataFrame) -> DataFrame:
        x = F.transform("embedding", lambda v: v.cast("double"))
        df = df.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
        df = df.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        return df.where(F.exists("x", lambda v: v != 0))

    rows, queries = usable(rows), usable(queries)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    facts = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("top"))
    facts = facts.orderBy(F.desc("n"), "d").limit(1).collect()
    if not facts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, total = facts[0].d, facts[0].n
    hashing = Hashing(d, float(np.sqrt(facts[0].top)))
    rows, queries = (x.where(F.size("x") == d).dropDuplicates(["id"]) for x in (rows, queries))
    shape = "bucket long, id long, x array<double>"
    index = stored(rows.mapInArrow(_bucketed(hashing, False), shape))
    asked = stored(queries.mapInArrow(_bucketed(hashing, True), shape))
    found = stored(_ranked(_search(asked, index, k), k))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    rest = stored(queries.join(enough, queries.id == enough.query_id, "left_anti"))
    if not rest.isEmpty():
        whole = _search(rest.withColumn("bucket", F.lit(0).cast("long")), rows.withColumn("bucket", F.lit(0).cast("long")), k)
        found = found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(whole, k))
    return found.select("query_id", "rank", "vec_id", "score")
