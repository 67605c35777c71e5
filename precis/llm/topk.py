"""Exact top-k inner products by dual-tree search over cover trees.

Distinct vectors are dealt to blocks of bounded size by their nearest of a few pivots (the top of the tree); each block is a
cover tree: a node has a centre, a covering radius, and children that cover it at half the radius. Queries get
blocks and trees of their own. A query block first meets the data blocks of its pivot, which gives every query a worst
kth score; then all other block pairs whose bound over both covering radii reaches the worst kth score of the query
block. Inside a pair the two trees are walked together under the same bound. Ties are never pruned.

Equal vectors are one point with their k + 1 smallest ids, enough for any top k without the query itself."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

PIVOTS = 64  # vectors sent to the driver and back: a bounded sample, any choice is exact
BLOCK = 2048  # distinct vectors in a block, or about
LEAF = 48
TOGETHER = 16  # query blocks that meet a data block in one task


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int, k: int) -> DataFrame:
    """(_key, _ids): floor(scale * x) of each distinct valid vector, as little-endian int64, with its k + 1 smallest
    distinct ids of this batch."""
    schema = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_ids", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            rows: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    rows.setdefault(np.floor(scale * x).astype("<i8").tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.binary()), pa.array([sorted(set(v))[:k + 1] for v in rows.values()],
                                                             pa.list_(pa.int64()))], names=schema.names)

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), vector_col).mapInArrow(run, schema)


def _points(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(len(keys), -1).astype(np.float64)


class Tree:
    """A cover tree over the rows of ``x``: nodes in arrays, points in tree order."""

    def __init__(self, x: np.ndarray, ids: list[list[int]]):
        self.center, self.radius, self.span, self.children, order = [], [], [], [], []
        self._grow(x, np.arange(len(x)), int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))), order)
        order = np.array(order)
        self.x = x[order]
        self.center = x[np.array(self.center)]
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((self.center ** 2).sum(axis=1))
        size = np.array([len(ids[i]) for i in order])
        self.ids = np.array([i for o in order for i in ids[o]], np.int64)
        self.id_ends = np.concatenate(([0], np.cumsum(size)))

    def pack(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpack(cls, blob: bytes) -> "Tree":
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(blob))
        return tree

    def _grow(self, x, points, center, order) -> int:
        node = len(self.center)
        dist = np.sqrt(((x[points] - x[center]) ** 2).sum(axis=1))
        radius = float(dist.max())
        self.center.append(center), self.radius.append(radius), self.span.append(None), self.children.append([])
        begin = len(order)
        groups = self._cover(x, points, center, dist, radius / 2) if len(points) > LEAF and radius > 0 else None
        if groups is None:
            order.extend(points.tolist())
        else:
            self.children[node] = [self._grow(x, g, c, order) for c, g in groups]
        self.span[node] = (begin, len(order))
        return node

    @staticmethod
    def _cover(x, points, center, dist, reach):
        """Centres more than ``reach`` apart, farthest first, with their nearest points; None if nearly every point
        would be its own."""
        near, owner, centers = dist.copy(), np.zeros(len(points), np.int64), [center]
        while near.max() > reach:
            if len(centers) > len(points) // 4:
                return None
            c = int(points[int(near.argmax())])
            d = np.sqrt(((x[points] - x[c]) ** 2).sum(axis=1))
            closer = d < near
            near, owner = np.where(closer, d, near), np.where(closer, len(centers), owner)
            centers.append(c)
        return [(c, points[owner == i]) for i, c in enumerate(centers) if (owner == i).any()]


def search(queries: Tree, data: Tree, best: np.ndarray, best_ids: np.ndarray) -> None:
    """Walk both trees together and merge the data's points into each query's best scores and ids (rows by score, then
    id; unfilled: lowest score, id -1)."""
    exact = np.abs(queries.x).max(initial=0) * np.abs(data.x).max(initial=0) * max(1, data.x.shape[1]) < 2.0 ** 53

    def bound(q, d):
        b = (queries.center[q] @ data.center[d] + queries.radius[q] * data.norm[d] + data.radius[d] * queries.norm[q]
             + queries.radius[q] * data.radius[d])
        return b + 1e-9 * (abs(b) + 1) + 0.5

    stack = [(0, 0)]
    while stack:
        q, d = stack.pop()
        a, b = queries.span[q]
        if bound(q, d) < best[a:b, -1].min():
            continue
        qs, ds = queries.children[q], data.children[d]
        if qs or ds:
            pairs = [(i, j) for i in (qs or [q]) for j in (ds or [d])]
            pairs.sort(key=lambda p: bound(*p))  # the most promising last, thus first
            stack += pairs
            continue
        c, e = data.span[d]
        if exact:
            s = (queries.x[a:b] @ data.x[c:e].T).astype(np.int64)
        else:
            s = queries.x[a:b].astype(np.int64) @ data.x[c:e].astype(np.int64).T
        live = np.flatnonzero((s >= best[a:b, -1:]).any(axis=1))
        if not len(live):
            continue
        ends = data.id_ends[c:e + 1]
        wide = np.repeat(s[live], np.diff(ends), axis=1)
        scores = np.concatenate((best[a:b][live], wide), axis=1)
        ids = np.concatenate((best_ids[a:b][live],
                              np.broadcast_to(data.ids[ends[0]:ends[-1]], wide.shape)), axis=1)
        top = np.lexsort((ids, -scores), axis=-1)[:, :best.shape[1]]
        best[a + live], best_ids[a + live] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)


_LOWEST = np.iinfo(np.int64).min + 1


def _blocks(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(block, pivot, center, radius, norm, tree): one row per block of ``points`` (_key, _ids)."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            x = _points(b.column(0).to_pylist()) if b.num_rows else np.zeros((0, shared.value.shape[1]))
            p = shared.value
            near = np.argmin((p ** 2).sum(axis=1) - 2 * x @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=["_key", "_ids", "pivot"])

    placed = settle(points.mapInArrow(assign, T.StructType([*points.schema.fields, T.StructField("pivot", T.LongType())])))
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "pivot")  # PIVOTS rows
    placed = placed.withColumn("block", F.concat_ws("/", "pivot", F.pmod(F.xxhash64("_key"), F.col("parts"))))
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("pivot", T.LongType()),
                           T.StructField("center", T.ArrayType(T.DoubleType())),
                           T.StructField("radius", T.DoubleType()), T.StructField("tree", T.BinaryType())])

    def grow(group: pa.Table) -> pa.Table:
        tree = Tree(_points(group["_key"].to_pylist()), group["_ids"].to_pylist())
        return pa.Table.from_arrays(
            [group["block"][:1], group["pivot"][:1], pa.array([tree.center[0]], pa.list_(pa.float64())),
             pa.array([float(tree.radius[0])]), pa.array([tree.pack()], pa.binary())], names=schema.names)

    return settle(placed.groupBy("block").applyInArrow(grow, schema))


_FOUND = "qid long, score long, vec_id long"


def _meet(pairs: DataFrame, queries: DataFrame, data: DataFrame, width: int) -> DataFrame:
    """Best scores of the queries of each (qblock, dblock, worst) pair; ``worst``: (qid, kth score) known so far."""
    dealt = pairs.withColumn("lot", F.dense_rank().over(Window.partitionBy("dblock").orderBy("qblock")))
    dealt = settle(dealt.withColumn("lot", F.floor(F.col("lot") / TOGETHER)))
    left = dealt.join(queries.select(F.col("block").alias("qblock"), "tree"), "qblock")
    right = (dealt.select(F.col("dblock").alias("_d"), F.col("lot").alias("_lot")).distinct()
             .join(data.select(F.col("block").alias("_b"), F.col("tree").alias("_tree")), F.col("_d") == F.col("_b")))

    def run(_, mine: pa.Table, other: pa.Table) -> pa.Table:
        tree = Tree.unpack(other["_tree"][0].as_py())
        out = []
        for blob, worst in zip(mine["tree"].to_pylist(), mine["worst"].to_pylist()):
            q = Tree.unpack(blob)
            n = len(q.x)
            best, ids = np.full((n, width), _LOWEST), np.full((n, width), -1)
            qids = q.ids[q.id_ends[:-1]]
            if worst:
                known = {r["qid"]: r["score"] for r in worst}
                best[:, -1] = [known.get(i, _LOWEST) for i in qids.tolist()]
                # a bound, not a result: scores below it can't enter, equal ones can
                best[:, :] = np.where(best[:, -1:] > _LOWEST, best[:, -1:] - 1, _LOWEST)
            search(q, tree, best, ids)
            real = ids >= 0
            out.append((np.repeat(qids, width)[real.ravel()], best[real], ids[real]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["qid", "score", "vec_id"])

    return left.groupBy("dblock", "lot").cogroup(right.groupBy("_d", "_lot")).applyInArrow(run, _FOUND)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over ``id_col``) selects, the ``k`` rows but itself
    with the largest inner product of floor(scale * x), ties to the smaller id; fewer if there are not so many.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; a vector
    only meets vectors of its length; rows that repeat an id and a vector are one; empty tables give no rows.
    Integer components are exact up to 2^53, and products as far as they fit a long."""
    valid = settle(integers(vectors, id_col, vector_col, scale, k))
    asking = settle(integers(vectors.where(is_query), id_col, vector_col, scale, 1 << 40)
                    .select("_key", F.explode("_ids").alias("query_id")).distinct())
    lengths = [r[0] for r in valid.select(F.octet_length("_key")).distinct().collect()]  # nearly always one
    out = None
    for n in sorted(lengths):
        part = _top_k(valid.where(F.octet_length("_key") == n), asking.where(F.octet_length("_key") == n), k)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _top_k(valid: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    width = k + 1
    points = settle(valid.groupBy("_key").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))), 1, width).alias("_ids")))
    asked = settle(asking.groupBy("_key").agg(F.min("query_id").alias("qid")))
    pivots = [bytes(r["_key"]) for r in points.orderBy(F.xxhash64("_key"), "_key").select("_key").limit(PIVOTS).collect()]
    if not len(pivots[0]):  # vectors of no components: all scores 0
        pivots = np.zeros((1, 0))
    else:
        pivots = _points(pivots)
    data = _blocks(points, pivots)
    queries = _blocks(asked.select("_key", F.array("qid").alias("_ids")), pivots)
    q = queries.select(F.col("block").alias("qblock"), F.col("pivot").alias("qpivot"), F.col("center").alias("qc"),
                       F.col("radius").alias("qr"))
    d = data.select(F.col("block").alias("dblock"), "pivot", F.col("center").alias("dc"), F.col("radius").alias("dr"))
    none = F.array().cast("array<struct<qid:bigint,score:bigint>>").alias("worst")
    near = settle(_meet(q.join(d, F.col("qpivot") == F.col("pivot")).select("qblock", "dblock", none), queries, data, width))

    by_query = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    kth = (near.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") == width).select("qid", "score"))
    owner = queries.mapInArrow(_members, "qblock string, qid long")
    worst = (owner.join(kth, "qid", "left").groupBy("qblock")
             .agg(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("qid", "score"))).alias("worst"),
                  F.min(F.coalesce("score", F.lit(_LOWEST))).alias("least")))  # BLOCK rows at most
    # every query block with the data blocks of every other pivot, kept if the bound lets a score in
    spread = q.join(worst, "qblock").withColumn("pivot", F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1))))
    norm = [F.sqrt(_dot(F.col(c), F.col(c))) for c in ("qc", "dc")]
    bound = _dot(F.col("qc"), F.col("dc")) + F.col("qr") * norm[1] + F.col("dr") * norm[0] + F.col("qr") * F.col("dr")
    pairs = (spread.where("pivot <> qpivot").join(d, "pivot").where(bound * (1 + 1e-9 * F.signum(bound)) + 1 >= F.col("least"))
             .select("qblock", "dblock", "worst"))
    found = near.unionAll(_meet(pairs, queries, data, width))
    top = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= width).drop("rank")
    mine = asking.join(asked, "_key").select("query_id", "qid")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (mine.join(top, "qid").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _members(batches):
    for b in batches:
        for block, blob in zip(b.column("block").to_pylist(), b.column("tree").to_pylist()):
            ids = Tree.unpack(blob).ids
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids)), pa.array(ids)], names=["qblock", "qid"])
