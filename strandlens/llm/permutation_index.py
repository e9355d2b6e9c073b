"""Approximate nearest neighbours by a permutation index.

Every vector is described by the order of its nearest pivots. An inverted file per pivot lists the vectors that have it
among their nearest, with its place in their order. A query walks the files of its own pivots, adding up how far places
lie apart (the footrule distance, a missing pivot at full distance); the nearest quarter is ranked again by
inner products of the original vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, stage

PIVOTS = 256  # vectors of the sample that serves as pivots, at most
NEAREST = 48  # pivots in a vector's order
SHARE = 0.25  # of a slice's vectors, ranked again
QUERIES = 1024  # about so many queries are answered together
SLICES = 24  # parts of the vectors; each gives its own best for each query
CHUNK = 4096  # vectors posted at once


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows that take part, and the vectors' length. Null ids, null or zero vectors, ones with
    null or non-finite components, and ones of another length than most have no part; of rows that repeat an id the
    smallest vector counts."""
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = held.filter(~bad & F.exists("embedding", lambda x: x != 0))
    most = held.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    return held.filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), dim


def build(vectors: DataFrame, dim: int, pivots: int = PIVOTS, nearest: int = NEAREST) -> tuple[DataFrame, int]:
    """The index: vec_id, embedding and near (pivots by falling inner product), for every row. The pivots are the first
    ``pivots`` vectors by a hash of their id: a bounded sample that the driver holds."""
    sample = vectors.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(pivots).collect()
    points = np.array([r["embedding"] for r in sample], np.float64).reshape(-1, dim)
    length = np.sqrt((points**2).sum(axis=1, keepdims=True))
    points = points / np.where(length > 0, length, 1)
    near = min(nearest, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("embedding"), dim)
            order = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :near].astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), max(near, 1)).cast(pa.list_(pa.int32())) if near else pa.array([[]] * len(x), pa.list_(pa.int32()))
            yield {"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "near": lists}

    return stage(map_batches(vectors, "vec_id long, embedding array<double>, near array<int>", run), "permutations"), len(points)


def _footrule(queries: np.ndarray, posted: np.ndarray, pivots: int) -> np.ndarray:
    """How much nearer than the greatest distance each posted vector lies, for each query."""
    near = queries.shape[1]
    gain = np.zeros((len(queries), len(posted)), np.int32)

    def files(orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        return by // near, (by % near).astype(np.int32), np.searchsorted(flat[by], np.arange(pivots + 1))

    q_rows, q_places, q_at = files(queries)
    v_rows, v_places, v_at = files(posted)
    for p in range(pivots):
        q, v = slice(q_at[p], q_at[p + 1]), slice(v_at[p], v_at[p + 1])
        if q.start < q.stop and v.start < v.stop:
            gain[np.ix_(q_rows[q], v_rows[v])] += near - np.abs(q_places[q][:, None] - v_places[v][None, :])
    return gain


def search(index: DataFrame, pivots: int, dim: int, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank, vec_id, score. ``queries`` are ids of the index, whose rows are
    searched for among all other rows. Ties go to the smaller vec_id; with k candidates or fewer all are found.

    Queries are dealt to blocks of about QUERIES and vectors to SLICES; a task reads a block of queries, then streams
    over a slice of the vectors in chunks, so its memory is bounded whatever the table's size."""
    asked = index.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    count = asked.count()
    n_blocks = max(1, -(-count // QUERIES))
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64(F.lit("slice"), "vec_id"), F.lit(SLICES)).cast("int")
    q = asked.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), F.lit(0).alias("kind"), "vec_id", "embedding", "near")
    v = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), part.alias("slice"), F.lit(1).alias("kind"), "vec_id", "embedding", "near")
    rows = q.unionByName(v).repartition(n_blocks * SLICES, "block", "slice").sortWithinPartitions("block", "slice", "kind", "vec_id")

    def answer(q_ids, q_x, q_near, v_ids, v_x, v_near) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        gain = _footrule(q_near, v_near, pivots)
        keep = min(len(v_ids), max(int(np.ceil(share * len(v_ids))), 4 * k))
        for i, own in enumerate(q_ids):
            among = np.argpartition(-gain[i], keep - 1)[:keep] if keep < len(v_ids) else np.arange(len(v_ids))
            among = among[v_ids[among] != own]
            score = v_x[among] @ q_x[i]
            best = np.lexsort((v_ids[among], -score))[:k]
            yield i, v_ids[among[best]], score[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, held, best_ids, best_scores = None, None, [], []

        def out() -> dict:
            ids, scores = np.concatenate([*best_ids, np.zeros(0, np.int64)]), np.concatenate([*best_scores, np.zeros(0)])
            return {"query_id": np.repeat(held[0], [len(b) for b in best_ids]) if best_ids else np.zeros(0, np.int64), "vec_id": ids.astype(np.int64), "score": scores}

        for batch in batches:
            keys = batch.column("block").to_numpy() * (SLICES * 2) + batch.column("slice").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                for i in range(i, j, CHUNK):
                    here = batch.slice(i, min(CHUNK, j - i))
                    group, kind = divmod(int(keys[i]), 2)
                    got = (here.column("vec_id").to_numpy(), _matrix(here.column("embedding"), dim), here.column("near").flatten().to_numpy().reshape(len(here), -1))
                    if group != at:
                        if best_ids:
                            yield out()
                        at, held, best_ids, best_scores = group, None, [], []
                    if kind == 0:
                        held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got))
                        best_ids, best_scores = [np.zeros(0, np.int64)] * len(held[0]), [np.zeros(0)] * len(held[0])
                    elif held is not None:
                        for n, ids, scores in answer(*held, *got):
                            ids, scores = np.concatenate([best_ids[n], ids]), np.concatenate([best_scores[n], scores])
                            top = np.lexsort((ids, -scores))[:k]
                            best_ids[n], best_scores[n] = ids[top], scores[top]
        if best_ids:
            yield out()

    found = map_batches(rows, "query_id long, vec_id long, score double", run)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
