"""Exact top-k search by integer inner product, block at a time with pruning.

Candidates are cut into blocks of neighbouring identifiers. A block keeps its vectors as a forward index and the largest and
smallest weight of each term, whose sum over a query's terms bounds the score of everything in the block. Each query
visits blocks in descending order of that bound and stops when the next bound is below its k-th best score.

Spark moves groups of neighbouring blocks, which have bounds of their own. Each query first meets the group with the highest
bound, then the next few, then the rest; its k-th best score so far goes along, and a query is sent only to groups
whose bound reaches that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, ship, written

#: Vectors in a block, blocks in a group, queries that meet a group in one task, queries scored together.
BLOCK, GROUP, BATCH, TILE = 256, 32, 4096, 256
#: Groups in one task when bounds are computed.
BOUNDS = 256
#: Groups that a query may have met after each round but the last.
ROUNDS = (1, 6)
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of each component; without null ids, vectors and components, and non-finite ones.

    A component beyond 64 bits is an error, as no score could hold it."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    found = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("q"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for k, n in enumerate(sizes):
        out[k, :n] = values[offsets[k] : offsets[k] + n]
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _largest(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


def _kind(a: np.ndarray, b: np.ndarray):
    """A type in which all inner products of rows of a and b are exact."""
    top = _largest(a) * _largest(b) * max(a.shape[1], 1)
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object


def _bounds(tile: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no score of a row of tile can exceed, by block; in 64 bits, larger ones at the limit."""
    zero = tile * 0
    bound = np.maximum(tile, zero) @ most.T + np.minimum(tile, zero) @ least.T
    if bound.dtype == object:
        bound = np.array([[max(NONE + 1, min(int(x), -(NONE + 1))) for x in row] for row in bound]).reshape(bound.shape)
    return bound.astype(np.int64)


def _scores(tile: np.ndarray, block: np.ndarray) -> np.ndarray:
    score = tile @ block.T
    if score.dtype == object:
        found = [[int(x) for x in row] for row in score]
        if any(not NONE < x < -NONE for row in found for x in row):
            raise OverflowError("a score is beyond 64 bits")
        score = np.array(found).reshape(score.shape)
    return score.astype(np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k best of the vectors m (ids ascending) for each query, without what is known to be below its kth score;
    and how many pairs of query and block were scored."""
    width = max(q.shape[1], m.shape[1])
    q, m = _wide(q, width), _wide(m, width)
    kind = _kind(q, m)
    blocks = [(ids[at : at + BLOCK], m[at : at + BLOCK].astype(kind)) for at in range(0, len(ids), BLOCK)]
    q = q.astype(kind)
    most, least = np.array([b.max(axis=0) for _, b in blocks], kind), np.array([b.min(axis=0) for _, b in blocks], kind)
    out, scored = [], 0
    for at in range(0, len(q), TILE):
        tile, own, floor = q[at : at + TILE], q_ids[at : at + TILE], kth[at : at + TILE]
        bound = _bounds(tile, most, least)
        order = np.argsort(-bound, axis=1, kind="stable")
        best, best_id = np.full((len(tile), k), NONE), np.full((len(tile), k), np.iinfo(np.int64).max)
        going = np.arange(len(tile))
        for turn in range(len(blocks)):
            block = order[going, turn]
            # A bound equal to the k-th score may hide a smaller identifier.
            still = bound[going, block] >= np.maximum(best[going, k - 1], floor[going])
            going, block = going[still], block[still]
            if not len(going):
                break
            scored += len(going)
            for b in np.unique(block):
                some = going[block == b]
                score = _scores(tile[some], blocks[b][1])
                names = blocks[b][0]
                score[names[None, :] == own[some, None]] = NONE
                _take(best, best_id, some, score, names, k)
        n, j = np.nonzero((best != NONE) & (best >= floor[:, None]))
        out.append((own[n], best_id[n, j], best[n, j]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), scored


def _take(best, best_id, some, score, names, k) -> None:
    """Puts a block's scores into the k best of these queries; names ascend, so the first of equal scores wins."""
    if score.shape[1] > 2 * k:
        # All of a row's scores that may be among its k best: those not below the row's k-th, ties included.
        kth = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, -k], best[some, k - 1])
        n, j = np.nonzero((score >= kth[:, None]) & (score != NONE))
        by = np.lexsort((j, -score[n, j], n))
        n, j = n[by], j[by]
        rank = np.arange(len(n)) - np.searchsorted(n, n)
        n, j, rank = n[rank < k], j[rank < k], rank[rank < k]
        new, new_id = np.full((len(some), k), NONE), np.full((len(some), k), np.iinfo(np.int64).max)
        new[n, rank], new_id[n, rank] = score[n, j], names[j]
    else:
        new, new_id = score, np.where(score == NONE, np.iinfo(np.int64).max, np.broadcast_to(names, score.shape))
    s, i = np.concatenate([best[some], new], axis=1), np.concatenate([best_id[some], new_id], axis=1)
    by = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
    best[some], best_id[some] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


GROUPS = "group long, n long, width int, ids binary, weights binary, most array<long>, least array<long>"


def _group(number: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """A row of GROUPS: vectors in order of their identifiers, with the largest and smallest weight of each term."""
    cells = ((number, pa.int64()), (len(ids), pa.int64()), (m.shape[1], pa.int32()), (ids.astype("<i8").tobytes(), pa.binary()), (m.astype("<i8").tobytes(), pa.binary()))
    edges = ((m.max(axis=0, initial=NONE).tolist(), pa.list_(pa.int64())), (m.min(axis=0, initial=-NONE - 1).tolist(), pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (*cells, *edges)], [c.split()[0] for c in GROUPS.split(", ")])


def _vectors(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"][0].as_py(), "<i8")
    return ids, np.frombuffer(row["weights"][0].as_py(), "<i8").reshape(len(ids), row["width"][0].as_py())


def _groups(batches):
    """Rows in order of vec_id -> groups of up to BLOCK * GROUP vectors, numbered in that order."""
    task, nth, held, size = TaskContext.get().partitionId(), 0, None, BLOCK * GROUP
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows >= size:
            yield _group(task << 32 | nth, held["vec_id"][:size].to_numpy(), matrix(held["q"][:size]))
            held, nth = held.slice(size), nth + 1
    if held is not None and held.num_rows:
        yield _group(task << 32 | nth, held["vec_id"].to_numpy(), matrix(held["q"]))


def _joined(parts: pa.Table) -> pa.Table:
    """Neighbouring groups as one."""
    parts = parts.sort_by("group")
    found = [_vectors(parts.slice(k, 1)) for k in range(parts.num_rows)]
    width = max(m.shape[1] for _, m in found)
    return pa.Table.from_batches([_group(parts["bundle"][0].as_py(), np.concatenate([ids for ids, _ in found]), np.concatenate([_wide(m, width) for _, m in found]))])


def _bound_cell(queries: pa.Table, groups: pa.Table) -> pa.Table:
    """query_id, group, bound for all queries and groups of a cell."""
    names = ["query_id", "group", "bound"]
    if not queries.num_rows or not groups.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names)
    q, most, least = matrix(queries["q"]), matrix(groups["most"]), matrix(groups["least"])
    width = max(q.shape[1], most.shape[1])
    q, most, least = (_wide(x, width) for x in (q, most, least))
    kind = _kind(q, np.concatenate([most, least]))
    bound = _bounds(q.astype(kind), most.astype(kind), least.astype(kind))
    ids, group = queries["vec_id"].to_numpy(), groups["group"].to_numpy()
    return pa.table([pa.array(np.repeat(ids, len(group))), pa.array(np.tile(group, len(ids))), pa.array(bound.reshape(-1))], names)


def _cell(k: int):
    def run(queries: pa.Table, groups: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not groups.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        ids, m = _vectors(groups)
        found = search(queries["query_id"].to_numpy(), matrix(queries["q"]), queries["kth"].to_numpy(), ids, m, k)
        return pa.table([pa.array(c) for c in found[:3]], names)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Both tables have vec_id and q (array<long>), none null. A candidate with the query's own vec_id is never returned.
    Repeated candidate rows count as often as they occur, repeated queries once; a shorter vector counts as ending in
    zeros. Scores beyond 64 bits are an error. An empty table on either side gives an empty result; other columns are not
    looked at. report gets the pairs of query and group that were searched, and all of them.
    """
    spark = candidates.sparkSession
    ship(spark)
    ordered = candidates.select("vec_id", "q").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    small = written(ordered.mapInArrow(_groups, GROUPS), "groups")
    # However the ranges were cut, groups are of one size: their numbers only (one for thousands of vectors) are added up in order.
    before = F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    bundles = small.select("group", F.floor(F.coalesce(before, F.lit(0)) / (BLOCK * GROUP)).alias("bundle"))
    groups = written(small.join(bundles, "group").groupBy("bundle").applyInArrow(_joined, GROUPS), "groups")
    queries = written(queries.select("vec_id", "q").distinct(), "queries")
    if groups.isEmpty() or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, sides = -(-queries.count() // BATCH), -(-groups.count() // BOUNDS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("side", every(sides)).groupBy("part", "side")
    right = groups.select("group", "most", "least").withColumn("side", F.pmod(F.xxhash64("group"), F.lit(sides)).cast("int")).withColumn("part", every(parts)).groupBy("part", "side")
    bounds = left.cogroup(right).applyInArrow(_bound_cell, "query_id long, group long, bound long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "group"))
    bounds = written(bounds.withColumn("place", place), "bounds")

    best, before = None, 0
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for upto in (*ROUNDS, None):
        now = bounds.where(F.col("place") > before) if upto is None else bounds.where(F.col("place").between(before + 1, upto))
        if best is None:
            now = now.withColumn("kth", F.lit(NONE))
        else:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            now = now.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE))).where("bound >= kth")
        now = written(now.select("query_id", "group", "kth"), "visits")
        if report is not None:
            report["searched"] = report.get("searched", 0) + now.count()
            report["all"] = bounds.count()
        # A group meets its queries in cells of about BATCH each, however many want it.
        cells = now.groupBy("group").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("cells"))
        asked = now.join(cells, "group").withColumn("cell", F.pmod(F.xxhash64("query_id"), "cells").cast("int")).join(queries.select(F.col("vec_id").alias("query_id"), "q"), "query_id")
        met = groups.select("group", "width", "ids", "weights").join(cells, "group").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        found = asked.select("group", "cell", "query_id", "q", "kth").groupBy("group", "cell").cogroup(met.select("group", "cell", "width", "ids", "weights").groupBy("group", "cell"))
        found = found.applyInArrow(_cell(k), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k), "best")
        before = upto
    return best.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(load(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
