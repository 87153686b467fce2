"""Whitening of embeddings by a bit-sliced scatter matrix.

An entry c of a vector becomes the whole number x = floor(SCALE * c). The fit list has each distinct x-vector once. Its exact
sums and cross-products come from bits: a batch of vectors is shifted by its least entry per dimension, and the bits of one
weight of one dimension over all rows of the batch are packed into words, a bit plane. The cross-product of two dimensions is
the sum over their planes of 2 ** (weights) times the number of ones in the AND of the planes. The shift is taken back in whole
numbers, so batches with shifts of their own add up. The covariance is centred in whole numbers, n * cross - sum * sum, and
only then divided and given to eigh.

What a task hands on is one sum per pair of dimensions, whatever the number of rows. Sums are carried in limbs of LIMB bits, so
they are exact at any size.

Rows whose vector is null, or has null or non-finite entries, take no part. Nor do vectors of another length than most (the
shorter of two equally frequent lengths counts). Entries beyond a long, |c| of some 3.6e16, count as the largest long. Components
whose eigenvalue is zero to the precision of the matrix have a null `whitened`, and explain 0; a table of equal vectors has only
such ones. Deviations beyond a long are exact as decimals. Repeated rows have equal results; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256

#: Bits of a limb, limbs of a sum: 2 ** 180 is beyond any sum of products of longs over 2 ** 50 rows.
LIMB, LIMBS = 30, 6

#: Vectors packed at once: 64 words a plane.
BATCH = 4096


def levels(vector: str | Column) -> Column:
    """The whole numbers of a vector; null where it takes no part."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def common_length(vectors: DataFrame, column: str = "x") -> int | None:
    """The length that most vectors have, the shorter one of equals; None without any."""
    sizes = vectors.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return sizes["size"] if sizes else None


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper triangle) of the columns of whole numbers, by bit planes."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = x.view("u8") - low.view("u8")  # modulo 2 ** 64, so right over the whole range of a long
    bits = [int(m).bit_length() for m in shifted.max(axis=0)]
    starts = np.concatenate([[0], np.cumsum(bits)]).astype(int)
    planes = np.zeros((starts[-1], -(-rows // 64)), "u8")
    for d in range(dims):
        for p in range(bits[d]):
            ones = np.packbits(((shifted[:, d] >> np.uint64(p)) & np.uint64(1)).astype(bool))
            planes[starts[d] + p].view("u1")[: len(ones)] = ones
    counts = np.zeros((len(planes), len(planes)), "i8")
    for d in range(dims):
        for k in range(starts[d], starts[d + 1]):
            counts[k, starts[d] :] = np.bitwise_count(planes[starts[d] :] & planes[k]).sum(axis=1, dtype="i8")
    alone = counts.diagonal()
    exact = 2 * max(bits, default=0) + rows.bit_length() > 62  # beyond that, Python's whole numbers
    weights = np.array([1 << p for b in bits for p in range(b)], object if exact else "i8")
    sums, cross = np.zeros(dims, object), np.zeros((dims, dims), object)
    filled = np.flatnonzero(bits)  # a constant dimension has no plane
    if len(filled):
        at = starts[filled]
        weighed = counts.astype(weights.dtype) * weights[:, None] * weights
        sums[filled] = np.add.reduceat(alone.astype(weights.dtype) * weights, at).astype(object)
        cross[np.ix_(filled, filled)] = np.add.reduceat(np.add.reduceat(weighed, at, axis=0), at, axis=1).astype(object)
    low = low.astype(object)
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return sums + rows * low, np.triu(cross)


def _limbs(value: int) -> list[int]:
    """Whole number to limbs, the last one with the sign."""
    return [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


@dataclass(frozen=True)
class Model:
    """n vectors of the fit list with sums S; the first eigenvectors as columns, eigenvalues falling, and the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace else None for v in self.values]


def fit(vectors: DataFrame, components: int = 4, column: str = "x") -> Model | None:
    """The model of a table of whole-number vectors of one length, each of which counts once however often it comes."""
    distinct = vectors.select(F.col(column).alias("x")).distinct()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, held, size = 0, None, [], 0

        def fold():
            nonlocal n, total, held, size
            sums, cross = scatter(np.concatenate(held))
            both = np.vstack([sums, cross])
            n, total, held, size = n + size, both if total is None else total + both, [], 0

        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(len(x), -1)
            for at in range(0, len(flat), BATCH):
                held.append(flat[at : at + BATCH])
                size += len(held[-1])
                if size >= BATCH:
                    fold()
        if held:
            fold()
        if total is None:
            return
        i, j = np.concatenate([[-2], np.full(total.shape[1], -1), np.triu_indices(total.shape[1])[0]]), np.concatenate(
            [[0], np.arange(total.shape[1]), np.triu_indices(total.shape[1])[1]]
        )
        values = [n, *total[0], *total[1:][np.triu_indices(total.shape[1])]]
        limbs = list(zip(*(_limbs(int(v)) for v in values)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))]
        )

    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    summed = distinct.mapInArrow(partial, schema).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    found = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in summed.toLocalIterator()}
    if not found:
        return None
    n, dims = found[-2, 0], 1 + max((j for i, j in found if i == -1), default=-1)
    sums = [found[-1, d] for d in range(dims)]
    covariance = np.zeros((dims, dims))
    for (i, j), cross in found.items():
        if i >= 0:
            covariance[i, j] = covariance[j, i] = (n * cross - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    first = slice(None, -components - 1, -1)
    values, axes = values[first], axes[:, first]
    top = max(values, default=0.0)
    values = np.where(values > top * dims * np.finfo(float).eps, values, 0.0)
    return Model(n, tuple(sums), axes, values, float(np.trace(covariance)))


def project(x: Column, model: Model) -> Column:
    """deviation: the sum over dimensions of (n * x - S) ** 2, a decimal; whitened: (x - S / n) on each component over the
    root of its eigenvalue, null where that is zero."""
    n, sums = model.n, np.array(model.sums, object)
    scale = np.array([1 / np.sqrt(v) if v else np.nan for v in model.values]) / n

    @F.arrow_udf("struct<deviation: decimal(38, 0), whitened: array<double>>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import decimal

        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(len(batch), len(sums))
            widest = n * max(1, int(np.abs(flat.astype("f8")).max(initial=0))) + max((abs(int(s)) for s in sums), default=0)
            small = 2 * widest.bit_length() + len(sums).bit_length() < 62
            moved = flat * n - sums.astype("i8") if small else flat.astype(object) * n - sums
            deviations = [decimal.Decimal(int(v)) for v in (moved * moved).sum(axis=1)]
            fits = [v if v.adjusted() < 38 else None for v in deviations]
            white = (moved.astype("f8") @ model.vectors) * scale
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel(), from_pandas=True), white.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(fits, pa.decimal128(38, 0)), lists], names=["deviation", "whitened"])

    return projected(x)


def identity_error(vectors: DataFrame, model: Model, column: str = "x") -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over the components with a
    whitened value; None if there is none."""
    used = [k for k, v in enumerate(model.values) if v]
    if not used:
        return None
    distinct = vectors.select(F.col(column).alias("x")).distinct()
    white = distinct.select(project(F.col("x"), model)["whitened"].alias("w")).select(*[F.col("w")[k].alias(f"w{k}") for k in used])
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))
