"""Near-duplicates by order MinHash with verification by banded alignment.

A text is its sequence of shingles of K words in lower case, each labelled with how often the same shingle came before; a
text of fewer words is one shingle. The sketch of a text has ELEMENTS elements: for each of as many hash functions, the
LEAST shingles of smallest hash, in the order in which the text has them. Texts that share an element are candidates.

Two texts are linked if their similarity is at least THRESHOLD: the length A of the longest common chain of labelled
shingles in the same order, over the number of shingles of both less A. It never exceeds the Jaccard similarity of
the labelled shingles and equals it where nothing has moved. The chain is sought only on diagonals that a similar
pair can reach. Classes are the connected components of the links; equal texts are in one class in any case.

A linked pair shares no element with probability (1 - s ** LEAST) ** ELEMENTS, 5e-6 at s = 0.8, and then can
still be in one class through others. Texts of up to SHORT shingles, where draws without replacement make that worse, also
have their first shingles in order of hash as elements, so no such pair is lost. Texts with a common element are a bucket.
Each text is compared with the most central one, that is the one that shares most elements with others, of its largest bucket
only. That puts large groups of copies together. Then one text of each class in a bucket is compared with one of its
largest class.

Buckets that still hold several classes go through an exact join. Shingles are put in an order
with rare ones first. Of the chain of a linked pair of n and m shingles, at least A = t / (1 + t) * (n + m) long, the first
one in that order is among the first n - A + 1 shingles of the one and m - A + 1 of the other, on diagonals at most
n + m - 2 * A apart in the texts. So texts of different classes are candidates if they have such a shingle, and no linked pair
of the buckets is lost. Groups of one class make no pairs, and the largest class of a group isn't paired with itself. The rows
of this join are at most the texts outside the largest class of a shingle times its texts, so they are linear in a group of
copies and square in the number of unlike texts that have one of their rarest shingles in common.

Null texts count as empty; texts without a word are similar only to equal ones. Texts are read whole. Null ids are
allowed: such rows have a class like any others, and a class of only such rows has a null class_id. Repeated rows have one
class. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, free_name, text_of
from tideline.llm.components import components

K = 5
LEAST = 4
ELEMENTS = 24
THRESHOLD = 0.8
SHORT = 16

#: Counters for how many texts have a shingle; shingles that share one only look more frequent than they are.
SLOTS = 1 << 20

#: Words whose hash a worker remembers before it starts anew.
MEMO = 150_000

_RNG = np.random.default_rng(20)
_SEEDS = _RNG.integers(0, 1 << 63, ELEMENTS, "u8") * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, ELEMENTS, "u8") * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, words: Words) -> np.ndarray:
    """Hashes of the labelled shingles in the order of the text."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, "u8")
    ids = np.fromiter(map(words.__getitem__, split), "u8", len(split))
    size = min(K, len(ids))
    with np.errstate(over="ignore"):
        out = np.full(len(ids) - size + 1, size, "u8")
        for i in range(size):
            out = out * _BASE + ids[i : len(ids) - size + 1 + i]
        out = _mix(out)
        order = np.argsort(out, kind="stable")
        ordered = out[order]
        first = np.append(True, ordered[1:] != ordered[:-1])
        if not first.all():
            place = np.arange(len(out))
            before = place - np.maximum.accumulate(np.where(first, place, 0))
            label = np.empty(len(out), "u8")
            label[order] = before
            out = np.where(label > 0, _mix(out + label * _BASE), out)
    return out


def _first(n: int, threshold: float) -> int:
    """So many of a text's shingles, in an order that all texts have in common, hold one of any pair's chain."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def sketch(labelled: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The elements of a text, as 64-bit hashes; none for a text without words."""
    n = len(labelled)
    if not n:
        return np.zeros(0, "i8")
    out, step = [], max(1, 2_000_000 // n)
    with np.errstate(over="ignore"):
        for j in range(0, ELEMENTS, step):
            seeds, odd = _SEEDS[j : j + step, None], _ODD[j : j + step, None]
            if n > LEAST:
                least = np.argpartition((labelled ^ seeds) * odd, LEAST - 1, axis=1)[:, :LEAST]
                chosen = labelled[np.sort(least, axis=1)]
            else:
                chosen = np.broadcast_to(labelled, (len(seeds), n))
            element = seeds[:, 0]
            for i in range(chosen.shape[1]):
                element = _mix(element * _BASE + chosen[:, i])
            out.append(element)
        if n <= SHORT:
            out.append(_mix(np.sort(labelled)[: _first(n, threshold)] + _BASE))
    return np.unique(np.concatenate(out)).view("i8")


def chain(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Length of the longest common chain of labelled shingles, 0 if it can't reach the threshold."""
    needed = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < needed - 1e-9:
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # every diagonal step leaves a shingle out, and there is room for so many
    near = np.abs(i - j) <= len(a) + len(b) - 2 * needed + 1e-9
    i, j = i[near], j[near]
    if len(i) < needed - 1e-9:
        return 0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The similarity of two texts' labelled shingles; 0 if it is below the threshold."""
    if not len(a) or not len(b):
        return 0.0
    found = chain(a, b, threshold)
    value = found / (len(a) + len(b) - found)
    return value if value >= threshold - 1e-12 else 0.0


def _elements(text: Column, threshold: float) -> Column:
    """The number of shingles and the elements."""

    @F.arrow_udf("struct<size: int, elements: array<bigint>>")
    def elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for batch in batches:
            sizes, rows = [], []
            for text in batch:
                labelled = shingles(text.as_py(), words)
                sizes.append(len(labelled))
                rows.append(sketch(labelled, threshold))
            offsets = np.cumsum([0, *map(len, rows)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, "i8")))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), lists], names=["size", "elements"])

    return elements(text)


def _similarities(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b, their roots and the similarity, for the pairs (a, a_text, a_root, b, b_text, b_root) that reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, recent = Words(), OrderedDict()

        def of(node: bytes, text: pa.Scalar) -> np.ndarray:
            found = recent.pop(node, None)
            recent[node] = found = shingles(text.as_py(), words) if found is None else found
            if len(recent) > 16:
                recent.popitem(last=False)
            return found

        for batch in batches:
            a, at, a_root, b, bt, b_root = batch.columns
            values = pa.array((similarity(of(x.as_py(), s), of(y.as_py(), t), threshold) for x, s, y, t in zip(a, at, b, bt)), pa.float64())
            found = pa.RecordBatch.from_arrays([a, a_root, b, b_root, values], names=["a", "a_root", "b", "b_root", "similarity"])
            yield found.filter(pc.greater(values, 0))

    ends = pairs.select("a", "a_text", "a_root", "b", "b_text", "b_root")
    return ends.mapInArrow(compare, "a binary, a_root binary, b binary, b_root binary, similarity double")


def _keyed(docs: DataFrame, text: str) -> list[Column]:
    """said: the text; node: a hash of it; row and row2: a hash of all columns."""
    said, keys = text_of(text), [F.col(c) for c in docs.columns]
    return [said.alias("said"), F.unhex(F.md5(said.cast("binary"))).alias("node"), F.xxhash64(*keys).alias("row"), F.hash(*keys).alias("row2")]


def _buckets(nodes: DataFrame) -> DataFrame:
    """(element, node, size, n, weight, root) for elements that several texts have. size is the number of shingles, n that of
    texts in the bucket, weight says how much a text shares in all, and every text is its own root so far."""
    each = nodes.select("node", "size", F.explode("elements").alias("element"))
    sizes = each.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(each.join(sizes, "element"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    return cut(shared.join(weights, "node").withColumn("root", F.col("node")))


def _joined(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root) over the roots that the pairs (node, root, b, b_root) link."""
    ends = F.sort_array(F.array(F.struct("node", "root"), F.struct(F.col("b").alias("node"), F.col("b_root").alias("root"))))
    pairs = pairs.select(ends.alias("e")).distinct()
    pairs = cut(pairs.select(*[F.col("e")[i][c].alias(n) for i, c, n in ((0, "node", "a"), (1, "node", "b"), (0, "root", "a_root"), (1, "root", "b_root"))]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return components(_similarities(both, threshold).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))


def _slots(labelled: np.ndarray) -> np.ndarray:
    return (labelled >> np.uint64(32)).astype("i8") % SLOTS


def _counts(texts: DataFrame) -> np.ndarray:
    """For each slot, how many texts have its shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Words(), np.zeros(SLOTS, "i8")
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(n, _slots(shingles(text.as_py(), words)), 1)
        slots = np.flatnonzero(n)
        for at in range(0, len(slots), 1 << 16):
            part = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, "i8")
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _rare(texts: DataFrame, threshold: float) -> DataFrame:
    """(shingle, node, root, size, rank, place): each text's first shingles, rare ones first, but for those that no other has."""
    shared = texts.sparkSession.sparkContext.broadcast(_counts(texts))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), shared.value
        for batch in batches:
            for node, root, text in zip(batch.column("node"), batch.column("root"), batch.column("text")):
                labelled = shingles(text.as_py(), words)
                n, often = len(labelled), counts[_slots(labelled)]
                places = np.lexsort((labelled, often))[: _first(n, threshold)]
                ranks = np.flatnonzero(often[places] > 1)
                places = places[ranks]
                columns = [
                    pa.array(labelled[places].view("i8")), pa.array([node.as_py()] * len(ranks), pa.binary()), pa.array([root.as_py()] * len(ranks), pa.binary()),
                    pa.array(np.full(len(ranks), n), pa.int32()), pa.array(ranks, pa.int32()), pa.array(places, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "node", "root", "size", "rank", "place"])

    own = texts.select("node", "root", "text")
    return own.mapInArrow(first, "shingle long, node binary, root binary, size int, rank int, place int")


def _mixed(members: DataFrame) -> DataFrame:
    """(element, node, root) of the buckets that hold several classes."""
    ends = members.groupBy("element").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return members.join(ends.select("element"), "element", "left_semi")


def _rest(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root, b, b_root): the candidates of different classes among the members of buckets that hold several."""
    nodes = _mixed(members).select("node", "root").distinct()
    rare = cut(_rare(cut(nodes.join(texts, "node")), threshold))
    each = rare.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "root"))["root"].alias("largest"))
    grouped = cut(rare.join(groups.where("classes > 1").select("shingle", "largest"), "shingle"))
    others = grouped.where(F.col("root") != F.col("largest")).drop("largest")
    any_ = grouped.select("shingle", "largest", *[F.col(c).alias(n) for c, n in (("node", "b"), ("root", "b_root"), ("size", "m"), ("rank", "b_rank"), ("place", "b_place"))])
    chain = F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("m")) - 1e-9
    near = F.abs(F.col("place") - F.col("b_place")) <= F.col("size") + F.col("m") - 2 * chain
    reach = (F.col("size") - F.col("rank") >= chain) & (F.col("m") - F.col("b_rank") >= chain)
    once = (F.col("b_root") == F.col("largest")) | (F.col("node") < F.col("b"))
    return others.join(any_, "shingle").where((F.col("root") != F.col("b_root")) & once & reach & near).select("node", "root", "b", "b_root")


def _with_centre(members: DataFrame, threshold: float) -> DataFrame:
    """(node, root, b, b_root): each member with the most central one of its bucket, where that is of another class."""
    centre = members.groupBy("element").agg(F.max(F.struct("rank", "node", "size", "root")).alias("c"))
    centre = centre.select("element", *[F.col(f"c.{c}").alias(f"b{s}") for c, s in (("node", ""), ("size", "_size"), ("root", "_root"))])
    # texts of lengths further apart can't reach the threshold
    alike = F.least("size", "b_size") >= threshold * F.greatest("size", "b_size") - 1e-9
    return members.join(centre, "element").where((F.col("root") != F.col("b_root")) & alike)


def _links(buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """(node, root) over all texts that are linked to another one.

    First each text goes to the largest of its buckets only, so a group of copies is put together by one row of each. Then
    each class of a bucket sends its most central text, and what is still mixed goes through the exact join.
    """
    largest = buckets.groupBy("node").agg(F.max(F.struct("n", "element", "size", "weight", "root")).alias("m")).select("node", "m.*")
    roots, members = None, buckets
    for step in ("largest", "classes", "rest"):
        if step == "largest":
            pairs = _with_centre(largest.withColumn("rank", F.col("weight")), threshold)
        elif step == "classes":
            sent = members.groupBy("element", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "node", "size")).alias("m"))
            pairs = _with_centre(sent.select("element", "root", "m.node", "m.size", F.struct("n", "m.weight").alias("rank")), threshold)
        else:
            pairs = _rest(members, texts, threshold)
        joined = _joined(pairs, texts, threshold)
        if joined.isEmpty():
            continue
        moved = joined.withColumnRenamed("root", "to")
        if roots is None:
            roots = joined
        else:
            old = roots.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = cut(old.unionByName(joined.join(roots.select("node"), "node", "left_anti")))
        if step != "rest":
            members = cut(members.join(moved.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"))
    return roots


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, row, row2, root): the class of each row is its root. Rows keep their number.

    row and row2 identify the rows that are equal in all of docs' columns.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_keyed(docs, text))
    sketched = cut(rows.select("doc_id", "node", "row", "row2", _elements(F.col("said"), threshold).alias("s")))
    nodes = sketched.groupBy("node").agg(F.min(F.struct("row", "row2")).alias("r"), F.first("s").alias("s")).select("node", "r", "s.*")
    buckets = _buckets(nodes)
    # one row stands for all equal texts; equal rows are found more than once and taken once
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "r.row", "r.row2")
    texts = rows.select("said", "row", "row2").join(wanted, ["row", "row2"]).groupBy("row", "row2", "node").agg(F.first("said").alias("text"))
    roots = _links(buckets, cut(texts.select("node", "text")), threshold)
    slim = sketched.drop("s")
    if roots is None:
        return slim.withColumn("root", F.col("node"))
    return slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def class_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for each row; class_id is the smallest doc_id of the class."""
    found = cut(classes(docs, doc_id, text, threshold))
    least = cut(found.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return found.select("doc_id", "root").join(least, "root").select("doc_id", "class_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with the columns it came with. A row without id stays only
    in a class of such rows, the one of smallest hash."""
    found = classes(docs, doc_id, text, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "row2"))
    kept = found.groupBy("root").agg(first.alias("r")).select("r.row", "r.row2")
    row, row2 = free_name(docs, "_row"), free_name(docs, "_row2")
    keys = [F.col(c) for c in docs.columns]
    keyed = docs.withColumns({row: F.xxhash64(*keys), row2: F.hash(*keys)})
    kept = kept.select(F.col("row").alias(row), F.col("row2").alias(row2))
    return keyed.join(kept, [row, row2], "left_semi").dropDuplicates([row, row2]).drop(row, row2)
