"""Near-duplicates by bottom-k sketches of one hash function.

1. Every text becomes the set of its five-word shingles, known by 64-bit hashes; texts with equal sets are one class.
   A class keeps the k smallest hashes as its sketch.
2. Inverted lists hold the classes of every retained value that occurs twice. Two sets with a similarity of 0.75
   share at least ``least_overlap`` values of their sketches (for k = 64 less than 24 of 64 have a probability below
   1e-10, and sets that fit into a sketch are exact), so a class enters the lists of its rarest values only, so many
   that one of them must be shared.
3. Classes joined by lists form clusters. A task takes a cluster, or a pair of blocks of one that is too large: from
   each unvisited class it counts overlaps through the inverted lists, estimates the similarity from the sketch of the
   union, and compares the full sets of those that may reach the threshold. Only a spanning link per class comes out.
4. Connected components of the links give the component of every document.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; with fewer than five
words the whole sequence is one shingle; rows that repeat a text are one class; rows without doc_id take part in
linking, are never kept, and have a null component_id if no member of the component has an id; an empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.graphs import connected_components
from repurchase.llm.storage import stored

SHINGLE = 5
THRESHOLD = 75
K = 64
SURE_OVERLAP = 24
# Estimates from a sketch of 64 have a deviation of at most 0.0625; pairs this far below the threshold are left out.
# An estimate of SURE_OVERLAP in 64 passes, so this misses no pair more than the overlaps do.
MARGIN = THRESHOLD / 100 - SURE_OVERLAP / 64
# Shingles of one block; a task holds two blocks at most.
BLOCK_SHINGLES = 2_000_000
SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up), np.cumprod(down)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of texts that lie one after the other in ``data`` (UTF-8)."""
    n = len(data)
    if n == 0:
        return [np.array([], dtype=np.uint64) for _ in offsets[1:]]
    x = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    word = ~((x == 32) | ((x >= 9) & (x <= 13)))
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[offsets < n]] = True
    before = np.concatenate([[False], word[:-1]]) & ~first[:n]
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) & ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up)])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX[1])
    bounds = np.searchsorted(starts, offsets)
    run = np.zeros(max(len(h) - SHINGLE + 1, 0), dtype=np.uint64)
    for j in range(SHINGLE):
        run = mixed(run * BASE + h[j : j + len(run)])
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(run[a : b - SHINGLE + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for v in h[a:b]:
                one = mixed(np.array([one * BASE + v], dtype=np.uint64))[0]
            sets.append(np.array([one], dtype=np.uint64))
        else:
            sets.append(np.array([], dtype=np.uint64))
    return sets


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text, or single rows: (first, end, bytes, offsets)."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketches(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, body (digest of the text), n, key (digest of the set; null if empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, data, offsets in text_slices(batch, "_text"):
                    sets = shingle_sets(data, offsets)
                    keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id")[i:j], batch.column("body")[i:j], pa.array([len(s) for s in sets], pa.int64()),
                            pa.array(keys, pa.binary()), _lists([s[:k] for s in sets]),
                        ],
                        names=["doc_id", "body", "n", "key", "sketch"],
                    )

    rows = documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("body"), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, body binary, n long, key binary, sketch array<long>")


def least_overlap(n, k: int = K):
    """How many values two linked sets share of their sketches at least, if one has n shingles."""
    small = F.ceil(n * THRESHOLD / 100).cast("int")
    return F.when(n <= k * THRESHOLD // 100, small).otherwise(F.lit(SURE_OVERLAP * k // 64))


def inverted_lists(classes: DataFrame, k: int = K) -> DataFrame:
    """value, cid: the rarest retained values of each class, as many as needed to meet every linked class."""
    values = classes.select("cid", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    repeated = values.join(shared, "value")
    sizes = classes.select("cid", F.size("sketch").alias("s"), least_overlap(F.col("n"), k).alias("c"))
    by_rarity = Window.partitionBy("cid").orderBy("df", "value")
    ranked = repeated.withColumn("i", F.row_number().over(by_rarity)).withColumn("alone", F.count("*").over(Window.partitionBy("cid")))
    # Values that no other class has are the rarest of all.
    return ranked.join(sizes, "cid").where(F.col("i") <= F.col("alone") - F.col("c") + 1).select("value", "cid")


class Block:
    """Classes held by one task: full sets and sketches, flat, with inverted lists of the retained values."""

    def __init__(self, sets: list[np.ndarray], k: int = K):
        self.k, self.n = k, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        vocabulary, self.ids = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(vocabulary), dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        sizes = np.minimum(self.n, k)
        self.sketch = np.full((len(sets), k), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i, s in enumerate(sets):
            self.sketch[i, : sizes[i]] = s[:k]
        self.sizes = sizes
        self.index(np.arange(len(sets)))

    def index(self, rows: np.ndarray) -> None:
        """Inverted lists over the given rows."""
        inside = np.arange(self.k)[None, :] < self.sizes[rows, None]
        owner = np.broadcast_to(rows[:, None], inside.shape)[inside]
        values = self.sketch[rows][inside]
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.first = np.concatenate([first, [len(values)]])
        self.owner = owner[order]

    def overlaps(self, i: int) -> np.ndarray:
        """Shared retained values of row i with every row."""
        own = self.sketch[i, : self.sizes[i]]
        at = np.searchsorted(self.values, own)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == own)]
        lists = [self.owner[self.first[a] : self.first[a + 1]] for a in at]
        return np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n), dtype=np.int64)

    def estimates(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Similarity of row i and others from the k smallest values of each union."""
        own = self.sketch[i, : self.sizes[i]]
        other = self.sketch[rows]
        valid = np.arange(self.k)[None, :] < self.sizes[rows, None]
        below = np.searchsorted(own, other)
        shared = valid & (own[np.minimum(below, len(own) - 1)] == other)
        both = np.cumsum(shared, axis=1) - shared
        place = np.arange(self.k)[None, :] + below - both
        union = len(own) + self.sizes[rows] - shared.sum(axis=1)
        return (shared & (place < self.k)).sum(axis=1) / np.minimum(union, self.k)

    def linked(self, i: int, rows: np.ndarray) -> np.ndarray:
        """The rows whose full sets reach the threshold with that of row i."""
        if not len(rows):
            return rows
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.mark[own] = 1
        counts = self.n[rows]
        ends = np.cumsum(counts)
        flat = np.repeat(self.at[rows] - (ends - counts), counts) + np.arange(ends[-1])
        common = np.add.reduceat(self.mark[self.ids[flat]], ends - counts)
        self.mark[own] = 0
        return rows[100 * common >= THRESHOLD * (self.n[i] + counts - common)]

    def components(self) -> np.ndarray:
        """For each row the first row of its component."""
        n = len(self.n)
        root, open_, indexed = np.full(n, -1), np.ones(n, dtype=bool), n
        exact = self.n <= self.k * THRESHOLD // 100
        for seed in range(n):
            if not open_[seed]:
                continue
            open_[seed], root[seed], queue = False, seed, [seed]
            while queue:
                i = queue.pop()
                left = int(open_.sum())
                if not left:
                    continue
                if left * 2 < indexed:
                    self.index(np.flatnonzero(open_))
                    indexed = left
                least = math.ceil(self.n[i] * THRESHOLD / 100) if exact[i] else SURE_OVERLAP * self.k // 64
                rows = np.flatnonzero((self.overlaps(i) >= least) & open_)
                small, large = np.minimum(self.n[rows], self.n[i]), np.maximum(self.n[rows], self.n[i])
                rows = rows[100 * small >= THRESHOLD * large]
                rows = rows[self.estimates(i, rows) >= THRESHOLD / 100 - MARGIN]
                found = self.linked(i, rows)
                open_[found], root[found] = False, seed
                queue.extend(found.tolist())
        return root


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """cluster, blocks, cid, set of the wanted classes (rep, body, cid, cluster, blocks), from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, data, offsets in text_slices(batch, "_text"):
                    own = [batch.column(c)[i:j] for c in ("cluster", "blocks", "cid")]
                    yield pa.RecordBatch.from_arrays([*own, _lists(shingle_sets(data, offsets))], names=["cluster", "blocks", "cid", "set"])

    text = F.coalesce("text", F.lit(""))
    texts = documents.select(F.coalesce("doc_id", F.lit(-1)).alias("_doc"), F.unhex(F.md5(text)).alias("body"), text.alias("_text"))
    keyed = wanted.select(F.coalesce("rep", F.lit(-1)).alias("_doc"), "body", "cid", "cluster", "blocks")
    joined = texts.join(keyed, ["_doc", "body"]).dropDuplicates(["_doc", "body"])
    return joined.select("cluster", "blocks", "cid", "_text").mapInArrow(run, "cluster long, blocks int, cid long, set array<long>")


def links(sets: DataFrame) -> DataFrame:
    """a, b: every class of a component of a task, with the first class of it; part: whether the task held only a part
    of its cluster, whose blocks meet in pairs."""
    own = F.pmod(F.xxhash64("cid", F.lit(4)), "blocks").cast("int")
    tasks = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "blocks", "cid", "set")

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cids, sets_ = None, [], []

        def done() -> pa.RecordBatch:
            order = np.argsort(np.array(cids), kind="stable")
            ids = np.array(cids, dtype=np.int64)[order]
            root = Block([sets_[o] for o in order]).components()
            keep = root != np.arange(len(root))
            part = pa.array(np.full(int(keep.sum()), key[3] > 1))
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]]), part], names=["a", "b", "part"])

        for batch in tables:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "blocks"))))
            column = batch.column("set")
            flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            for n, (name, cid) in enumerate(zip(names, batch.column("cid").to_pylist())):
                if name != key:
                    if len(cids) > 1:
                        yield done()
                    key, cids, sets_ = name, [], []
                cids.append(cid)
                sets_.append(flat[ends[n] : ends[n + 1]].copy())
        if len(cids) > 1:
            yield done()

    dealt = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(work, "a long, b long, part boolean")


def near_duplicates(documents: DataFrame, k: int = K, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = stored(sketches(documents, k), "sketches")
    # One document stands for all with the same set.
    classes = stored(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.min_by("body", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("body"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    lists = stored(inverted_lists(classes, k), "lists")
    hubs = lists.groupBy("value").agg(F.min("cid").alias("hub"))
    edges = lists.join(hubs, "value").where("cid != hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    clusters = stored(connected_components(edges), "clusters")
    wanted = classes.join(clusters.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), "cid")
    blocks = wanted.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    wanted = wanted.select("rep", "body", "cid", "cluster").join(blocks, "cluster")
    found = stored(links(full_sets(documents, wanted)), "links")
    if found.where("part").isEmpty():
        # Every cluster was in one task, so each class has its root already.
        found = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        found = connected_components(found.select("a", "b"))
    named = classes.select("key", "cid", "rep").join(found.select(F.col("node").alias("cid"), "root"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_key = named.join(smallest, "root").select("key", "component_id")
    empty = rows.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.where("key is not null").join(by_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without those that are near-duplicates of one that comes earlier by (doc_id, row), null ids last.

    Rows are told apart by a stored number, so rows that share a doc_id, or have none, are judged by their texts alone.
    """
    # Packed, so that no column can clash with the row number.
    rows = stored(documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*documents.columns).alias("document")), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text")))
    named = rows.select("row", F.col("document.doc_id").alias("doc_id")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select("document.*")
