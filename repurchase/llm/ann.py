"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gets its neighbour graph, which is cut into partitions of equal size so that
neighbours stay together. A small softmax classifier learns which partition a vector belongs to. It then places every
vector into its most probable partition and sends each query to the partitions that together hold enough of the
probability; the vectors there are compared exactly, in double precision. Large partitions are split into blocks, to each
of which the query goes.

The number of partitions grows with the root of the number of vectors. How much probability is enough is measured: vectors
of the sample that the classifier has not seen look for their nearest ones in it, and the least mass that finds
``GOAL`` of them is taken. Clustered vectors are found in few partitions, vectors without structure in many.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part; with fewer than 20 candidates all are given; equal scores go by the smaller vec_id; rows that repeat a
vec_id or lack one: those without are left out, repeated ones are candidates each, and the smallest vector is the query; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.storage import stored

SAMPLE = 6000
# Partitions per root of the number of vectors, and vectors of the sample a partition needs.
PER_ROOT, LEAST_ROWS = 0.6, 40
NEIGHBOURS = 10
# Share of the nearest vectors that held-out queries must find, and the masses that are tried.
GOAL = 0.94
MASSES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 1.0)
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
TOP = 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite & F.exists(v, lambda x: x != 0))
    rows = rows.select("vec_id", v.cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most about ``size`` vectors, chosen by a hash of their id."""
    n = rows.count()
    share = min(1.0, size / max(n, 1))
    kept = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("vec_id")
    found = kept.select("v").toArrow().column("v").combine_chunks()
    return found.flatten().to_numpy().reshape(len(found), -1) if len(found) else np.zeros((0, 1))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row, as row numbers."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Labels of equal frequency that cut few edges.

    Starts from balanced centres, then nodes move to the part most of their neighbours are in, strongest wish first,
    as long as that part has room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    cap = -(-n // parts) + max(1, n // parts // 20)
    centres = x[rng.choice(n, parts, replace=False)]

    def assign(scores: np.ndarray) -> np.ndarray:
        labels, left = np.full(n, -1), np.full(parts, cap)
        choices = np.argsort(-scores, axis=1)
        strength = scores[np.arange(n), choices[:, 0]]
        for i in np.argsort(-strength, kind="stable"):
            for p in choices[i]:
                if left[p]:
                    labels[i], left[p] = p, left[p] - 1
                    break
        return labels

    for _ in range(8):
        labels = assign(x @ centres.T)
        centres = np.stack([x[labels == p].mean(axis=0) if (labels == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    both = [np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])]), np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])]
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (both[1], labels[both[0]]), 1.0)
        own = votes[np.arange(n), labels]
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - own
        left = cap - np.bincount(labels, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if left[best[i]] > 0 and rng.random() < 0.7:
                left[best[i]] -= 1
                left[labels[i]] += 1
                labels[i] = best[i]
                moved += 1
        if not moved:
            break
    return labels


def train_classifier(x: np.ndarray, labels: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 300) -> np.ndarray:
    """Weights of a softmax regression (the last row is the intercept), by full-batch accelerated descent.

    A row's goal is the share of its neighbours in each part, so probabilities tell where neighbours are to be found.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((a.shape[1], parts))
    goal = np.eye(parts)[labels[graph]].mean(axis=1)
    speed = w.copy()
    rate = 4.0 / max(np.linalg.norm(a, 2) ** 2 / len(a), 1e-9)
    for i in range(rounds):
        ahead = w + 0.9 * speed
        z = a @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (a.T @ (p - goal) / len(a) + 1e-4 * ahead)
        w = w + speed
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = unit @ weights[:-1] + weights[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def enough_mass(x: np.ndarray, held: np.ndarray, weights: np.ndarray, goal: float = GOAL, top: int = TOP) -> float:
    """The least mass with which the rows ``held`` find ``goal`` of their nearest among the other rows."""
    if not len(held) or len(x) <= top:
        return 1.0
    near = x[held] @ x.T
    near[np.arange(len(held)), held] = -np.inf
    nearest = np.argpartition(-near, top - 1, axis=1)[:, :top]
    p = _probabilities(x, weights)
    home, own = p.argmax(axis=1), p[held]
    order = np.argsort(-own, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(own, order, axis=1), axis=1)
    before = np.empty_like(own)
    np.put_along_axis(before, order, np.concatenate([np.zeros((len(own), 1)), sums[:, :-1]], axis=1), axis=1)
    # A neighbour is found if the partitions before its own hold less than the mass.
    needed = np.take_along_axis(before, home[nearest], axis=1)
    return next((m for m in MASSES if (needed < m).mean() >= goal), 1.0)


def partitions(vectors: int, sampled: int) -> int:
    return max(1, min(round(PER_ROOT * vectors**0.5), sampled // LEAST_ROWS))


def fit(rows: DataFrame, parts: int | None = None, size: int = SAMPLE, neighbours: int = NEIGHBOURS, goal: float = GOAL) -> tuple[np.ndarray, float]:
    """Weights of the classifier and the mass that is enough, from a sample of at most about ``size`` vectors."""
    x = sample(rows, size)
    parts = partitions(rows.count(), len(x)) if parts is None else max(1, min(parts, len(x) // LEAST_ROWS))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1)), 1.0
    original, x = x, x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(x, neighbours)
    labels = balanced_partition(x, graph, parts)
    held = np.random.default_rng(7).permutation(len(x))[: len(x) // 10]
    seen = np.delete(np.arange(len(x)), held)
    weights = train_classifier(x[seen], labels, graph[seen], parts)
    return weights, enough_mass(original, held, weights, goal)


def route(rows: DataFrame, weights: np.ndarray, mass: float | None) -> DataFrame:
    """vec_id, v and part: the most probable part, or as many as make up ``mass``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                p = _probabilities(_matrix(batch.column("v")), weights)
                if mass is None:
                    n, part = np.arange(len(p)), p.argmax(axis=1)
                else:
                    order = np.argsort(-p, axis=1, kind="stable")
                    held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                    enough = np.concatenate([np.zeros((len(p), 1)), held[:, :-1]], axis=1) < mass
                    n, at_ = np.nonzero(enough)
                    part = order[n, at_]
                chosen = batch.take(pa.array(n))
                yield pa.RecordBatch.from_arrays([chosen.column("vec_id"), chosen.column("v"), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, part int")


def search(vectors: DataFrame, is_query: Column, top: int = TOP, parts: int | None = None, goal: float = GOAL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` found candidates of each query."""
    rows = stored(usable(vectors), "vectors")
    if rows.isEmpty():
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    weights, mass = fit(rows, parts, goal=goal)
    index = stored(route(rows, weights, None), "index")
    # Every part is cut into blocks of about ``block_rows`` vectors, by the hash of the id.
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = index.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int"))
    queries = route(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), weights, mass).join(blocks, "part")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Queries of one block are dealt out in chunks, so that a popular part is no single task either.
    asked = queries.groupBy("part", "block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    queries = queries.join(asked, ["part", "block"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), "chunks").cast("int"))
    placed = placed.join(asked, ["part", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def nearest(key, left, right):
        q, c = left.combine_chunks(), right.combine_chunks()
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = c.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
        x, y = _matrix(q.column("v").combine_chunks()), _matrix(c.column("v").combine_chunks())
        out = []
        for at in range(0, len(x), 256):
            scores = x[at : at + 256] @ y.T
            scores[own[at : at + 256, None] == ids[None, :]] = -np.inf
            k = min(top, scores.shape[1])
            # All candidates about as near as the k-th: products of whole blocks may differ in their last bits, so
            # those that count are computed anew one by one, and ties are settled by id.
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            n, j = np.nonzero((scores >= least - 1e-9 * (1 + np.abs(least))) & (scores > -np.inf))
            s = (x[at + n] * y[j]).sum(axis=1)
            order = np.lexsort((ids[j], -s, n))
            n, j, s = n[order], j[order], s[order]
            place = np.arange(len(n)) - np.searchsorted(n, n, side="left")
            keep = place < top
            out.append((own[at + n[keep]], ids[j[keep]], s[keep]))
        cat = [np.concatenate(p) for p in zip(*out)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    keys = ["part", "block", "chunk"]
    found = (
        queries.select(*keys, "vec_id", "v").groupBy(*keys)
        .cogroup(placed.select(*keys, "vec_id", "v").groupBy(*keys))
        .applyInArrow(nearest, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
