"""Hard negatives mined along spanning trees of the anchors.

Scores are integer inner products. Anchors are ordered by the signs of a few random projections, so that near ones stand
together, and cut into blocks of ``TREE`` anchors; each block gets the minimum spanning tree of the distances between
its anchors. A task takes a block of anchors and a block of candidates and walks the tree from its root:

* the root's scores are computed in full;
* a child's score of candidate x lies within the bounds of its parent's plus or minus edge length times the norm of x;
* only candidates whose bounds overlap what is asked for are scored anew; where the edge is 0, nothing is.

The first walk asks for the best rows of the anchor's label (positives), the second for the best rows of another label
whose score lies inside the window of each positive. Both are exact: a candidate is left out only if its bounds prove
that it is not among the best of its block, and windows over the few rows that blocks return settle the rest.

Neither the table nor the anchors ever stand in one task or on the driver. Anchors meet all rows, in blocks; a label or a
vector that most rows share makes no larger task, as blocks are dealt by position and by a hash of the row. How much the
bounds save depends on how near anchors are to each other: copies cost nothing, while of nearly orthogonal anchors every
candidate is scored.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part; vectors meet
those of their own length only (empty ones score 0); rows that repeat a vec_id are rows of their own, only the anchor's
own row is left out; equal scores go by the smaller vec_id; a window around a negative score is empty; anchors without
positives or positives without negatives give no rows; an empty table gives none. Components beyond +-``LIMIT`` after
scaling are held there, so that scores and bounds of up to 2,048 components fit a long. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.llm.storage import stored, with_start

SCALE = 256.0
LIMIT = 1 << 25
POSITIVES, NEGATIVES = 5, 10
# Percent of the positive's score between which a negative's must lie.
LOW, HIGH = 30, 90
# Anchors of a tree, and candidates of a block (of 64 components; fewer if they are longer).
TREE, BLOCK, LENGTH = 512, 8192, 64
# Sign bits that order the anchors; anchors with the same signs are split by a hash.
SIGNS, SPLIT = 12, 16
# Beyond this, sums of products are no longer exact in double precision.
EXACT = float(1 << 53)


def usable(rows: DataFrame, is_anchor: Column, label: Column) -> DataFrame:
    """row, vec_id, label, is_anchor, v (scaled whole numbers) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = rows.select("vec_id", label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), "embedding")
    taken = taken.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    held = F.transform(e, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "is_anchor", held.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as whole numbers in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def exact_products(x: np.ndarray, a: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of the rows of ``x``, whole numbers up to ``largest``, with ``a``."""
    if largest * float(np.abs(a).max(initial=0.0)) * len(a) < EXACT:
        return (x @ a).astype(np.int64)
    return x.astype(np.int64) @ a.astype(np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order they join the tree, the place of each one's parent in that order (-1: root), edge lengths.

    The tree is the minimum one; the row nearest to the mean is its root.
    """
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    order[0] = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    near, by, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    left[order[0]] = False
    for at in range(1, n):
        far = ((x - x[order[at - 1]]) ** 2).sum(axis=1)
        closer = left & (far < near)
        near[closer], by[closer] = far[closer], at - 1
        choice = int(np.argmin(np.where(left, near, np.inf)))
        order[at], parent[at], edge[at], left[choice] = choice, by[choice], np.sqrt(near[choice]), False
    return order, parent, edge


class Walk:
    """Bounds of the scores of one block of candidates, along a tree of anchors."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, x: np.ndarray) -> None:
        self.anchors, self.parent, self.edge, self.x = anchors, parent, edge, x
        # Lengths are rounded up, so that bounds stay bounds.
        self.norms = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
        self.largest = float(np.abs(x).max(initial=0.0))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.children = np.bincount(parent[parent >= 0], minlength=len(parent))
        self.scored = 0

    def _reach(self, length: float) -> np.ndarray:
        return np.ceil(length * (1 + 1e-12) * self.norms).astype(np.int64)

    def enter(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds at an anchor; anchors are entered in the order of the tree."""
        p = int(self.parent[at])
        if p < 0:
            low = exact_products(self.x, self.anchors[at], self.largest)
            high = low.copy()
            self.scored += len(low)
        else:
            low, high = self.known[p]
            slack, most = self._reach(self.edge[at]), self._reach(np.sqrt((self.anchors[at] ** 2).sum()))
            low, high = np.maximum(low - slack, -most), np.minimum(high + slack, most)
            self.children[p] -= 1
            if not self.children[p]:
                del self.known[p]
        if self.children[at]:
            # What is scored later on narrows the bounds of the children, too.
            self.known[at] = low, high
        return low, high

    def settle(self, at: int, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> None:
        """Score those of the candidates ``which`` that are not known yet."""
        unknown = which[low[which] < high[which]]
        if len(unknown):
            low[unknown] = high[unknown] = exact_products(self.x[unknown], self.anchors[at], self.largest)
            self.scored += len(unknown)


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def best(walk: Walk, at: int, low: np.ndarray, high: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """All candidates ``among`` that may be of the k best (more where the k-th score is shared), scored."""
    if len(among) > k:
        first = among[np.argpartition(-high[among], k - 1)[:k]]
        walk.settle(at, low, high, first)
        enough = _kth(low[among], k)
        among = among[high[among] >= enough]
    walk.settle(at, low, high, among)
    enough = _kth(low[among], k)
    return among if enough is None else among[low[among] >= enough]


def best_inside(walk: Walk, at: int, low: np.ndarray, high: np.ndarray, among: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """All candidates ``among`` that may be of the k best with least <= score <= most, scored."""
    for scored in (False, True):
        among = among[(high[among] >= least) & (low[among] <= most)]
        sure = among[(low[among] >= least) & (high[among] <= most)]
        enough = _kth(low[sure], k)
        if enough is not None:
            among = among[high[among] >= enough]
        if not scored:
            walk.settle(at, low, high, among)
    return among


def with_fields(schema: T.StructType, **added: str) -> T.StructType:
    out = T.StructType(list(schema.fields))
    for name, kind in added.items():
        out.add(name, kind)
    return out


def anchor_trees(rows: DataFrame, tree: int = TREE) -> DataFrame:
    """size, tree, at, parent, edge, row, vec_id, label, v: the anchors in the order they join their trees, stored."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = []
            for v in batch.column("v").to_pylist():
                # The projections depend on the length of the vector alone.
                if len(v) not in lines:
                    lines[len(v)] = np.random.default_rng(len(v)).standard_normal((SIGNS, len(v)))
                bits = lines[len(v)] @ np.asarray(v, dtype=np.float64) > 0
                # Read as Gray code: neighbours in the order differ in one sign.
                codes.append(int(np.logical_xor.accumulate(bits) @ (1 << np.arange(SIGNS)[::-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], names=[*batch.schema.names, "code"])

    anchors = rows.where("is_anchor").drop("is_anchor").withColumn("size", F.size("v"))
    anchors = anchors.mapInArrow(signs, with_fields(anchors.schema, code="integer"))
    # A code that most anchors share is placed by many tasks.
    anchors = anchors.withColumn("code", F.col("code") * SPLIT + F.pmod(F.xxhash64("row"), F.lit(SPLIT)).cast("int")).withColumn("one", F.lit(1))
    placed = with_start(stored(anchors, "anchors"), ["size"], "code", ["row"], "one", "place")
    placed = placed.withColumn("tree", F.floor(F.col("place") / tree).cast("int")).drop("place", "one", "code")

    def grow(key, table):
        order, parent, edge = spanning_tree(matrix(table.column("v")))
        out = table.take(pa.array(order))
        for name, values in (("at", pa.array(np.arange(len(order)), pa.int32())), ("parent", pa.array(parent, pa.int32())), ("edge", pa.array(edge, pa.float64()))):
            out = out.append_column(name, values)
        return out

    return stored(placed.groupBy("size", "tree").applyInArrow(grow, with_fields(placed.schema, at="integer", parent="integer", edge="double")), "trees")


POSITIVE = ("anchor", "row", "vec_id", "score")
NEGATIVE = ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "negative_id", "negative_score")


def _longs(names: tuple[str, ...]) -> str:
    return ", ".join(f"{name} long" for name in names)


def _table(names: tuple[str, ...], parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})


def _walk(anchors: pa.Table, block: pa.Table) -> tuple[Walk, np.ndarray, np.ndarray, np.ndarray]:
    parent, edge = (anchors.column(c).to_numpy() for c in ("parent", "edge"))
    walk = Walk(matrix(anchors.column("v")), parent, edge, matrix(block.column("v")))
    return walk, *(block.column(c).to_numpy() for c in ("row", "vec_id", "label"))


def mine(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = (LOW, HIGH), tree: int = TREE, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor the best ``positives`` other rows of its label, and for each of these the best ``negatives`` rows of
    another label that score between the two percentages of ``window`` of the positive's score.
    """
    vectors = stored(usable(rows, is_anchor, F.col("label") if label is None else label), "vectors")
    trees = anchor_trees(vectors, tree)
    # Two numbers for the driver: blocks of candidates, and trees of the most frequent length.
    blocks = vectors.agg(F.ceil(F.sum(F.greatest(F.size("v"), F.lit(LENGTH))) / (LENGTH * block))).first()[0] or 1
    most = trees.agg(F.max("tree")).first()[0] or 0
    keys = ["size", "tree", "block"]
    place = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = vectors.withColumn("size", F.size("v")).withColumn("block", place).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(most))))
    candidates = candidates.select(*keys, "row", "vec_id", "label", "v").groupBy(*keys)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1)))

    def best_positives(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _table(POSITIVE, [])
        anchors = left.sort_by("at")
        walk, row, ids, labels = _walk(anchors, right)
        parts = []
        for at, (anchor, kind) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "label")))):
            low, high = walk.enter(at)
            among = best(walk, at, low, high, np.flatnonzero((labels == kind) & (row != anchor)), positives)
            among = among[np.lexsort((row[among], ids[among], -low[among]))][:positives]
            parts.append([np.full(len(among), anchor), row[among], ids[among], low[among]])
        return _table(POSITIVE, parts)

    found = trees.withColumn("block", every_block).groupBy(*keys).cogroup(candidates).applyInArrow(best_positives, _longs(POSITIVE))
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    chosen = found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= positives)
    # An anchor has few positives.
    pair = F.struct(F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    listed = stored(chosen.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(pair).alias("positives")), "positives")

    def best_negatives(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _table(NEGATIVE, [])
        anchors = left.sort_by("at")
        walk, row, ids, labels = _walk(anchors, right)
        parts = []
        for at, (anchor, anchor_id, kind, pairs) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label", "positives")))):
            low, high = walk.enter(at)
            others = np.flatnonzero(labels != kind)
            for p in pairs or []:
                score = p["positive_score"]
                # The whole scores inside the window.
                among = best_inside(walk, at, low, high, others, -(-window[0] * score // 100), window[1] * score // 100, negatives)
                among = among[np.lexsort((row[among], ids[among], -low[among]))][:negatives]
                same = [np.full(len(among), v) for v in (anchor, anchor_id, p["positive"], p["positive_id"], score)]
                parts.append([*same, row[among], ids[among], low[among]])
        return _table(NEGATIVE, parts)

    wanted = trees.join(listed, "row", "left").withColumn("block", every_block)
    mined = wanted.groupBy(*keys).cogroup(candidates).applyInArrow(best_negatives, _longs(NEGATIVE))
    hardest = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "row")
    mined = mined.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
