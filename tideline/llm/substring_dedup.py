"""Removal of repeated passages by relative Lempel-Ziv parsing.

Words are runs of anything but space and the control characters 9 to 13. A window is SPAN consecutive words of a document; a
window whose words also start in a document of smaller id is a duplicate, and all words of duplicates go.

References. The anchor of a window is its GRAM words of smallest hash, the leftmost of equals, so equal windows have equal anchors.
The windows of a document that share an anchor follow each other; their words are a segment of fewer than 2 * SPAN words. Equal
segments of a document, as in texts that go round in a circle, are one. Of all segments with equal anchors, that of the smallest
id is the reference block of the anchor. A block is all that a document can share with that id around the anchor, and blocks
are bounded however often a passage occurs.

Parsing. Every segment is laid against the block of its anchor, and the longest factor through the anchor is taken: as far as
the words agree to the left and to the right. Windows within the factor are duplicates. Neighbouring segments overlap by SPAN - 1
words, so the factors of a passage join up.

Factor boundaries. Windows across an end of the factor aren't in the block, but may be in a third document. Two equal windows
leave the same block at the same distance from the anchor and with the same word, so these, the boundary, are their meeting point.
Boundaries of one document only are done with. What is left is compared window by window by 128-bit digests; the least id of each
is a partial aggregation. So a passage in any number of documents makes one row of each, and no pairs.

Documents that have the same words as one of smaller id are taken as one before the parsing, and go altogether if they have a window.

Null texts have no words. Rows without an id keep all words and are no reference. Repeated rows, and different texts of one id, are
judged each by itself: a window goes only for a smaller id. Texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, free_name, text_of

SPAN = 50
GRAM = 12

#: Words whose hash a worker remembers before it starts anew.
MEMO = 150_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | bytes | None) -> list[bytes]:
    """The words as UTF-8: bytes.split() parts at the ASCII blanks and nothing else."""
    return (text.encode() if isinstance(text, str) else text or b"").split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def anchors(found: list[bytes], hashes: Hashes) -> list[tuple[int, int, int, int]]:
    """(anchor, its place, first window, end of the windows) of each segment, in order."""
    if len(found) < SPAN:
        return []
    ids = np.fromiter(map(hashes.__getitem__, found), "u8", len(found))
    with np.errstate(over="ignore"):
        grams = np.full(len(ids) - GRAM + 1, GRAM, "u8")
        for i in range(GRAM):
            grams = grams * _BASE + ids[i : len(ids) - GRAM + 1 + i]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
    # the least of each run of SPAN - GRAM + 1 grams, from runs of doubled length
    run, size = grams, 1
    while 2 * size <= SPAN - GRAM + 1:
        run, size = np.minimum(run[:-size], run[size:]), 2 * size
    rest = SPAN - GRAM + 1 - size
    least = np.minimum(run[: len(run) - rest], run[rest:]) if rest else run
    # leftmost place of that gram at or after the start of the window
    order = np.lexsort((np.arange(len(grams)), grams))
    at = order[np.searchsorted(grams[order], least, side="left")]
    starts = np.arange(len(least))
    late = np.flatnonzero(at < starts)  # the gram came before as well
    if len(late):
        places = {int(g): np.flatnonzero(grams == g) for g in np.unique(least[late])}
        for s in late.tolist():
            own = places[int(least[s])]
            at[s] = own[np.searchsorted(own, s)]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    end = np.append(first[1:], len(at))
    return list(zip(grams[at[first]].view("i8").tolist(), at[first].tolist(), first.tolist(), end.tolist()))


def factor(segment: list[bytes], at: int, block: list[bytes], block_at: int) -> tuple[int, int]:
    """How many words agree to the left of the anchor, and from its first word to the right."""
    left, right = 0, 0
    while left < min(at, block_at) and segment[at - left - 1] == block[block_at - left - 1]:
        left += 1
    while right < min(len(segment) - at, len(block) - block_at) and segment[at + right] == block[block_at + right]:
        right += 1
    return left, right


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, n_words, grams): seq is the SHA-256 of the words joined by one space, grams the anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            seqs, sizes, grams = [], [], []
            for text in batch.column("text"):
                found = words(text.as_py())
                seqs.append(hashlib.sha256(b" ".join(found)).digest())
                sizes.append(len(found))
                grams.append(list({a[0] for a in anchors(found, hashes)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64()))],
                names=["doc_id", "seq", "n_words", "grams"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, seq binary, n_words long, grams array<long>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SEGMENT = pa.schema(
    [("gram", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.binary()), ("firsts", pa.list_(pa.int64())), ("at", pa.int32()),
     ("windows", pa.int32()), ("said", pa.binary()), ("is_block", pa.bool_())]
)


def _segments(texts: DataFrame) -> DataFrame:
    """(gram, doc_id, seq, firsts, at, windows, said, is_block) for the wanted anchors of (doc_id, text, seq, grams, own). A
    document's equal segments are one row; firsts has the first window of each."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            rows = []
            for doc_id, text, seq, grams, own in zip(*(batch.column(c) for c in ("doc_id", "text", "seq", "grams", "own"))):
                found = words(text.as_py())
                if hashlib.sha256(b" ".join(found)).digest() != seq.as_py():
                    continue  # another text of the same id
                wanted, own, firsts = set(grams.as_py()), set(own.as_py()), {}
                for gram, at, first, end in anchors(found, hashes):
                    if gram in wanted:
                        said = b" ".join(found[first : end + SPAN - 1])
                        firsts.setdefault((gram, at - first, end - first, said), []).append(first)
                for (gram, at, windows, said), places in firsts.items():
                    rows.append((gram, doc_id.as_py(), seq.as_py(), places, at, windows, said, gram in own))
                    own.discard(gram)
            for at in range(0, len(rows), 5000):
                yield _batch(rows[at : at + 5000], _SEGMENT)

    return texts.select("doc_id", "text", "seq", "grams", "own").mapInArrow(
        cut_up, "gram long, doc_id long, seq binary, firsts array<long>, at int, windows int, said binary, is_block boolean"
    )


_PARSED = pa.schema(
    [("doc_id", pa.int64()), ("seq", pa.binary()), ("firsts", pa.list_(pa.int64())), ("start", pa.int32()), ("end", pa.int32()),
     ("boundary", pa.int64()), ("said", pa.binary())]
)


def _parsed(met: DataFrame) -> DataFrame:
    """(doc_id, seq, firsts, start, end, boundary, said): windows start to end, counted from each of firsts, are duplicates if
    boundary is null; else they cross that boundary of a factor and said has their words."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "doc_id", "seq", "firsts", "at", "windows", "said", "block_id", "block_at", "block_said")
        for batch in batches:
            rows = []
            for gram, doc_id, seq, firsts, at, windows, said, block_id, block_at, block_said in zip(*(batch.column(c).to_pylist() for c in names)):
                segment = said.split()
                left, right = factor(segment, at, block_said.split(), block_at)
                # windows from `inner` on begin within the factor, those before `outer` end within it
                inner, outer = min(max(at - left, 0), windows), min(max(at + right - SPAN + 1, 0), windows)
                if inner < outer and block_id < doc_id:
                    rows.append((doc_id, seq, firsts, inner, outer, None, None))
                crossing = [(0, inner, b"<", left, at - left - 1), (max(inner, outer), windows, b">", right, at + right)]
                for start, end, side, distance, place in crossing:
                    if start < end:
                        boundary = xxhash.xxh3_64_intdigest(b"%d%s%d %s" % (gram, side, distance, segment[place])) - (1 << 63)
                        rows.append((doc_id, seq, firsts, start, end, boundary, b" ".join(segment[start : end + SPAN - 1])))
            yield _batch(rows, _PARSED)

    return met.mapInArrow(parse, "doc_id long, seq binary, firsts array<long>, start int, end int, boundary long, said binary")


_WINDOW = pa.schema([("doc_id", pa.int64()), ("seq", pa.binary()), ("firsts", pa.list_(pa.int64())), ("start", pa.int32()), ("digest", pa.binary())])


def _windows(crossing: DataFrame) -> DataFrame:
    """(doc_id, seq, firsts, start, digest) of each window of (doc_id, seq, firsts, start, end, said)."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, seq, firsts, start, end, said in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "firsts", "start", "end", "said"))):
                found = said.split()
                rows += [(doc_id, seq, firsts, start + i, xxhash.xxh3_128_digest(b" ".join(found[i : i + SPAN]))) for i in range(end - start)]
            yield _batch(rows, _WINDOW)

    own = crossing.select("doc_id", "seq", "firsts", "start", "end", "said")
    return own.mapInArrow(digests, "doc_id long, seq binary, firsts array<long>, start int, digest binary")


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """(key, least): the keys that more than one id has, with the smallest id."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return ends.where("least < most").select(key, "least")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seq, n_words, spans) for each row: the words to go as sorted, disjoint (start, end), in words. doc_id is a long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    scanned = cut(_scanned(rows))
    long_ = scanned.where(f"n_words >= {SPAN} and doc_id is not null")
    whole = long_.groupBy("seq").agg(F.min("doc_id").alias("least"), F.first("grams").alias("grams"))
    whole = cut(whole)
    postings = whole.select(F.col("least").alias("doc_id"), "seq", F.explode("grams").alias("gram"))
    shared = cut(_in_several(postings, "gram"))
    own = F.when(F.col("doc_id") == F.col("least"), F.col("gram"))
    wanted = postings.join(shared, "gram").groupBy("doc_id", "seq").agg(F.collect_list("gram").alias("grams"), F.collect_list(own).alias("own"))
    texts = cut(rows.join(wanted, "doc_id"))
    segments = cut(_segments(texts))
    block = F.min(F.struct("doc_id", "seq", "firsts", "at", "said")).alias("b")
    blocks = segments.where("is_block").groupBy("gram").agg(block)
    # a table of its own, so that Spark can split the segments of a frequent anchor
    blocks = cut(blocks.select("gram", F.col("b.doc_id").alias("block_id"), F.col("b.at").alias("block_at"), F.col("b.said").alias("block_said")))
    parsed = cut(_parsed(segments.join(blocks, "gram")))
    crossing = parsed.where("boundary is not null")
    windows = cut(_windows(crossing.join(_in_several(crossing, "boundary").select("boundary"), "boundary", "left_semi")))
    again = windows.join(_in_several(windows, "digest"), "digest").where("least < doc_id")
    found = parsed.where("boundary is null").select("doc_id", "seq", "firsts", "start", "end")
    found = found.unionByName(again.select("doc_id", "seq", "firsts", "start", (F.col("start") + 1).alias("end")))
    found = found.select("doc_id", "seq", F.explode("firsts").alias("first"), "start", "end")
    found = found.select("doc_id", "seq", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))
    ranges = F.sort_array(F.collect_set(F.struct("start", (F.col("end") + SPAN - 1).alias("end"))))
    parts = found.groupBy("doc_id", "seq").agg(_merged(ranges).alias("spans"))
    judged = scanned.select("doc_id", "seq", "n_words").join(whole.select("seq", "least"), "seq", "left").join(parts, ["doc_id", "seq"], "left")
    kind = "array<struct<start: bigint, end: bigint>>"
    copy = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return judged.select("doc_id", "seq", "n_words", F.when(F.col("least") < F.col("doc_id"), copy).otherwise(F.coalesce("spans", F.array())).cast(kind).alias("spans"))


def _merged(ranges: Column) -> Column:
    """Sorted ranges, those that touch or overlap put together."""

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= r["start"]), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast("array<struct<start: bigint, end: bigint>>"), step)


def cut_words(text: Column, spans_: Column) -> Column:
    """seq, the SHA-256 of all words joined by one space, and kept, the words that are in no span joined likewise."""

    @F.arrow_udf("struct<seq: binary, kept: string>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            seqs, out = [], []
            for said, going in zip(texts, ranges):
                found, at, left = words(said.as_py()), 0, []
                seqs.append(hashlib.sha256(b" ".join(found)).digest())
                for r in going.as_py() or []:
                    left += found[at : r["start"]]
                    at = r["end"]
                out.append(b" ".join(left + found[at:]).decode())
            yield pa.StructArray.from_arrays([pa.array(seqs, pa.binary()), pa.array(out, pa.string())], names=["seq", "kept"])

    return keep(text, spans_)


def kept_texts(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seq, kept) for the rows of spans() that lose some of their words; only their texts are read again. Rows with
    the same id and words have one row."""
    some = found.where(F.size("spans") > 0).where(F.get("spans", F.lit(0))["end"] - F.get("spans", F.lit(0))["start"] < F.col("n_words"))
    some = some.select("doc_id", F.col("seq").alias("wanted"), "spans").dropDuplicates(["doc_id", "wanted"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).join(some, "doc_id")
    both = rows.select("doc_id", "wanted", cut_words(F.col("text"), F.col("spans")).alias("c")).where("c.seq = wanted")
    return both.select("doc_id", "c.seq", "c.kept").dropDuplicates(["doc_id", "seq"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with the words that stay joined by one space as text where any go; columns and number of rows as before."""
    id_, seq, going = (free_name(docs, n) for n in ("_id", "_seq", "_spans"))
    found = spans(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["doc_id", "seq"])
    found = found.select(F.col("doc_id").alias(id_), F.col("seq").alias(seq), F.col("spans").alias(going))
    wanted = free_name(docs, "_words")
    own = docs.withColumn(wanted, cut_words(F.col(text), F.lit(None).cast(found.schema[going].dataType))["seq"])
    both = own.join(found, (F.col(doc_id).cast("long") == F.col(id_)) & (F.col(wanted) == F.col(seq)), "left")
    out = F.when(F.size(going) > 0, cut_words(F.col(text), F.col(going))["kept"]).otherwise(F.col(text))
    return both.select(*[out.alias(c) if c == text else F.col(c) for c in docs.columns])
