"""Hard negatives of anchors by best-first search in STR-packed R-trees.

A vector's entries become whole numbers, and scores are inner products with the anchor. Rows are dealt into blocks of some
BLOCK rows by label and leading coordinates, and anchors into parts of some PART; each part meets each block, in one group of
both. A block's rows are packed into a tree of bounding boxes (sort-tile-recursive, two tiles a level, along the coordinates
of largest spread). Over a box, coordinate c of an anchor contributes between the lesser and the greater of c * low and
c * high, which bounds the score of every row in it. The search takes boxes by falling upper bound, passes over boxes whose
interval is outside the score windows, and ends at the first whose upper bound is strictly below the kth score found. The best
rows of all blocks are merged by Spark.

A first search finds each anchor's positives, a second one, with the windows of all its positives at once, the negatives.

Rows with a null id, label or vector, with null or non-finite entries, or of another vector length than most, take no part. An
id is one row: of rows with equal ids the one of smallest label and vector counts. Entries are taken within LARGEST. Ties
go to the smaller id. Anchors without positives, and positives without negatives, have no rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut
from tideline.llm.whitening import common_length, levels

BLOCK = 16_384
PART = 2_048
LEAF = 128

#: Whole-number entries beyond this count as this: inner products of 64 entries then fit a long.
LARGEST = 1 << 28

Found = tuple[np.ndarray, np.ndarray]  # scores falling, ids of equals rising


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all sums that make up the inner products."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53


class Tree:
    """The packed boxes of a block. Node k has the children 2k + 1 and 2k + 2, the last level the rows of a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        spread = np.argsort(-x.std(axis=0), kind="stable") if len(x) else np.arange(x.shape[1])
        tiles = [np.arange(len(x))]
        for level in range(depth):
            split = []
            for rows in tiles:
                if x.shape[1]:
                    axis = x[rows, spread[level % x.shape[1]]]
                    rows = rows[np.argsort(axis, kind="stable")]
                split += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            tiles = split
        self.inner = len(tiles) - 1
        self.leaves = tiles
        self.low, self.high = (np.zeros((self.inner + len(tiles), x.shape[1])) for _ in range(2))
        for k, rows in enumerate(tiles):
            self.low[self.inner + k], self.high[self.inner + k] = x[rows].min(axis=0), x[rows].max(axis=0)
        for k in reversed(range(self.inner)):
            self.low[k] = np.minimum(self.low[2 * k + 1], self.low[2 * k + 2])
            self.high[k] = np.maximum(self.high[2 * k + 1], self.high[2 * k + 2])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the score of each anchor in each box, widened where doubles aren't exact."""
        up, down = np.maximum(anchors, 0).astype("f8"), np.minimum(anchors, 0).astype("f8")
        lower, upper = up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T
        slack = 0 if _exact(anchors, np.concatenate([self.low, self.high])) else 2.0**20
        return lower - slack, upper + slack


def search(tree: Tree, score, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, windows: list[tuple[int, int]], k: int, allowed: np.ndarray) -> list[Found]:
    """For each window (least, most) of scores, the k best allowed rows in it. score(rows) gives the rows' scores."""
    best = [(np.zeros(0, "i8"), np.zeros(0, "i8")) for _ in windows]
    queue = [(-upper[0], 0)]

    def wanted(node: int) -> bool:
        return any(
            upper[node] >= least and lower[node] <= most and (len(b[0]) < k or upper[node] >= b[0][-1]) for (least, most), b in zip(windows, best)
        )

    while queue:
        _, node = heapq.heappop(queue)
        if not wanted(node):
            continue
        if node < tree.inner:
            for child in (2 * node + 1, 2 * node + 2):
                heapq.heappush(queue, (-upper[child], child))
            continue
        rows = tree.leaves[node - tree.inner]
        rows = rows[allowed[rows]]
        scores, names = score(rows), ids[rows]
        for w, ((least, most), (s, i)) in enumerate(zip(windows, best)):
            new = (scores >= (max(least, s[-1]) if len(s) == k else least)) & (scores <= most)
            if new.any():
                s, i = np.concatenate([s, scores[new]]), np.concatenate([i, names[new]])
                order = np.lexsort((i, -s))[:k]
                best[w] = s[order], i[order]
    return best


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(len(table), dims)


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, find, schema: str) -> DataFrame:
    """find(rows, anchors) for each block of rows with each part of the anchors."""
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(find, schema)


def prepared(df: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x): the rows that take part, one for each id."""
    label = F.col(label) if isinstance(label, str) else label
    bounded = F.transform(levels(vector), lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)))
    rows = df.select(F.col(vec_id).alias("vec_id"), label.cast("long").alias("label"), bounded.alias("x")).dropna()
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    rows = cut(rows.select("vec_id", "r.label", "r.x"))
    return rows.where(F.size("x") == F.lit(common_length(rows)))


def _dealt(rows: DataFrame, n: int, dims: int, block: int) -> DataFrame:
    """Adds block: rows of near labels and leading coordinates lie in one block. Neighbouring partitions make up a block, so
    that blocks depend on the rows alone and not on how many partitions Spark deals."""
    order = ["label", *[F.col("x")[d] for d in range(min(3, dims))], "vec_id"]
    blocks = max(1, ceil(n / block))
    dealt = cut(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()))
    partitions = 1 + (dealt.agg(F.max("block")).first()[0] or 0)
    return dealt.withColumn("block", F.floor(F.col("block") * blocks / F.lit(max(partitions, blocks))).cast("int"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         block: int = BLOCK, part: int = PART, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for prepared() rows.

    Positives are the first other rows of the anchor's label; negatives the first rows of other labels whose score is from
    least to most hundredths of the positive's. is_anchor: a condition on vec_id.
    """
    spark, n, dims = rows.sparkSession, rows.count(), common_length(rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    rows = _dealt(rows, n, dims, block)
    anchors = rows.where(is_anchor).drop("block")
    parts = max(1, ceil(anchors.count() / part))
    blocks = 1 + rows.agg(F.max("block")).first()[0]
    anchors = cut(anchors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")))

    def answers(own: pa.Table, asked: pa.Table, windows_of, same: bool, k: int) -> Iterator[tuple[int, int, Found]]:
        """anchor, number of the window and what was found, for all anchors of a part."""
        if not len(own) or not len(asked):
            return
        x, a = _matrix(own, dims), _matrix(asked, dims)
        ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
        tree = Tree(x, leaf)
        fast = x.astype("f8") if _exact(a, x) else x
        lower, upper = tree.bounds(a)
        names, kinds = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
        for q in range(len(a)):
            allowed = (labels == kinds[q]) & (ids != names[q]) if same else labels != kinds[q]
            if allowed.any():
                anchor = a[q].astype(fast.dtype)
                found = search(tree, lambda r: (fast[r] @ anchor).astype("i8"), ids, lower[q], upper[q], windows_of(q), k, allowed)
                for w, best in enumerate(found):
                    yield q, w, best

    def nearest(own: pa.Table, asked: pa.Table) -> pa.Table:
        everything = [(-(1 << 62), 1 << 62)]
        found = [(int(asked["vec_id"][q].as_py()), s, i) for q, _, (s, i) in answers(own, asked, lambda q: everything, True, positives)]
        return pa.table(
            {
                "anchor_id": pa.array(np.repeat([a for a, _, _ in found], [len(s) for _, s, _ in found]), pa.int64()),
                "positive_id": pa.array(np.concatenate([np.zeros(0, "i8"), *(i for _, _, i in found)]), pa.int64()),
                "positive_score": pa.array(np.concatenate([np.zeros(0, "i8"), *(s for _, s, _ in found)]), pa.int64()),
            }
        )

    near = _met(anchors, rows, blocks, parts, nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    pairs = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("near"))
    asking = anchors.join(pairs.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def below(own: pa.Table, asked: pa.Table) -> pa.Table:
        near = asked["near"].to_pylist()
        # whole scores with least * p <= 100 * score <= most * p
        windows = [[(-(-least * p["positive_score"] // 100), most * p["positive_score"] // 100) for p in ps] for ps in near]
        names = asked["vec_id"].to_pylist()
        found = [(names[q], near[q][w], s, i) for q, w, (s, i) in answers(own, asked, windows.__getitem__, False, negatives)]
        sizes = [len(s) for _, _, s, _ in found]
        return pa.table(
            {
                "anchor_id": pa.array(np.repeat([a for a, _, _, _ in found], sizes), pa.int64()),
                "positive_id": pa.array(np.repeat([p["positive_id"] for _, p, _, _ in found], sizes), pa.int64()),
                "positive_score": pa.array(np.repeat([p["positive_score"] for _, p, _, _ in found], sizes), pa.int64()),
                "negative_id": pa.array(np.concatenate([np.zeros(0, "i8"), *(i for _, _, _, i in found)]), pa.int64()),
                "negative_score": pa.array(np.concatenate([np.zeros(0, "i8"), *(s for _, _, s, _ in found)]), pa.int64()),
            }
        )

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _met(asking, rows, blocks, parts, below, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
