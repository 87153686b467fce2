"""Benchmark passages in documents: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are compared as letters and digits in lower case with one space for anything else. Each benchmark item is looked
for by windows of WINDOW characters and of SHORT ones that start at every word (an item that is shorter than a window is a
window itself), so whether an excerpt is found doesn't depend on where it begins. A window of n characters occurs in a
text if some part of it aligns with at most e = EDITS * n edits; by the q-gram lemma such a part shares at least
n - Q + 1 - Q * e q-grams with it, on diagonals at most 2 * e apart. So q-grams that a text shares with an item are put
into bands of 2 * (2 * e + 1) diagonals that overlap by half, and windows that hold their bound of one band's are candidates.
Of neighbouring windows up to 64 common characters have to occur within the budget first, which all candidates of a chunk of
texts are tested for at once; what passes is aligned.
Items whose bound wouldn't be positive are looked for by SMALL_Q-grams instead, and then it is.

Items of fewer than LEAST characters in that form have no edit budget: they occur where their words stand one after the other.
Items without a letter or digit never occur; null items likewise. A null text
counts as empty and has no hits. Texts are searched whole. Repeated rows get repeated results. Copies of an item
give a hit each, and an item without id one with a null item_id. An empty benchmark or an empty table gives no hits.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 10
SMALL_Q = 8
WINDOW = 100
SHORT = 60
EDITS = 0.08
LEAST = 20

#: Characters of benchmark that are broadcast at once; a larger benchmark is searched for in several such parts.
PART_CHARS = 1_000_000

#: Characters of documents that a task looks at together.
CHUNK = 1 << 20

#: Windows whose letters a worker remembers before it starts anew.
MEMO = 2_000

#: Candidates that are tested at once, and bands that they are taken from.
BLOCK = 4_096

HITS = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"
_HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])

_OTHER = re.compile(r"[\W_]+")
_KEPT = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@cache
def _letters() -> np.ndarray:
    """Whether a character is a letter or digit, by its code."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def plains(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of plain(t) of each text with a zero after each; where each text begins, and last where all end."""
    lower = [t.lower() if t else "" for t in texts]
    codes, ends = _codes("\0".join([*lower, ""])), np.cumsum([len(t) + 1 for t in lower], dtype="i8") - 1
    letter = _letters()[codes]
    shown = letter.copy()
    # the first other character after a word stands for all of them, but not at a text's end
    shown[1:] |= letter[:-1]
    shown[ends] = True
    codes = np.where(letter, codes, np.uint32(32))
    codes[ends] = 0
    codes = codes[shown]
    codes = codes[np.append((codes[:-1] != 32) | (codes[1:] != 0), True)[: len(codes)]]
    return codes, np.append(0, np.flatnonzero(codes == 0) + 1)


def within(parts: np.ndarray, sizes: np.ndarray, budgets: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Whether each part, of up to 64 characters in a row, occurs in its region within its budget: as Windows.occurs, a column of all at once."""
    shift, one = (sizes - 1).astype("u8"), np.uint64(1)
    more, less = np.full(len(parts), ~np.uint64(0)), np.zeros(len(parts), "u8")
    score = sizes.astype("i8")
    best = score.copy()
    for column in regions.T:
        same = np.packbits(parts == column[:, None], axis=1, bitorder="little").view("<u8").ravel()
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up, low = less | ~(across | more), more & across
        score += (up >> shift & one).astype("i8") - (low >> shift & one).astype("i8")
        np.minimum(best, score, out=best)
        up, low = up << one, low << one
        more, less = low | ~(down | up), up & down
    return best <= budgets


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on, by doubling."""
    with np.errstate(over="ignore"):
        size, have = 1, codes.astype("u8") + np.uint64(1)
        one, power = have, _BASE
        for bit in f"{q:b}"[1:]:
            have = have[:-size] * power + have[size:] if len(have) > size else have[:0]
            size, power = 2 * size, power * power
            if bit == "1":
                have = have[: len(one) - size] * _BASE + one[size:][: max(0, len(one) - size)]
                size, power = size + 1, power * _BASE
        return have ^ (have >> np.uint64(29))


def _bound(sizes: np.ndarray, q: int) -> np.ndarray:
    """The q-grams that a place within the edit budget shares with a window, at least."""
    return sizes - q + 1 - q * (EDITS * sizes).astype("i8")


class Phrases:
    """Items too short for windows, found as whole words by one automaton."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids: dict[str, list[int | None]] = {}
        for item, text in rows:
            self.ids.setdefault(f" {text} ", []).append(item)
        self._automaton = None

    def __getstate__(self):
        return {"ids": self.ids, "_automaton": None}

    def search(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item, start, end) of the first place of each, in a text of the plain form."""
        if not self.ids:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for phrase in self.ids:
                self._automaton.add_word(phrase, phrase)
            self._automaton.make_automaton()
        first: dict[str, int] = {}
        for last, phrase in self._automaton.iter(f" {text} "):
            first.setdefault(phrase, last - len(phrase) + 1)
        return [(item, at, at + len(phrase) - 2) for phrase, at in first.items() for item in self.ids[phrase]]


@dataclass
class Windows:
    """Items of an index by q-grams, with those that it can't hold in an index of its own (small) and as phrases.

    ids: of the items, which may be null. codes: their characters. sizes, budgets, least: for the longer and the shorter windows of each item, their characters, edit budgets and q-gram bounds."""

    ids: list[int | None]
    codes: list[np.ndarray]
    sizes: np.ndarray
    budgets: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    q: int = Q
    small: Windows | None = None
    phrases: Phrases | None = None
    masks: dict[tuple[int, int, int], dict[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str]]) -> Windows:
        main, small, short = [], [], []
        for item, text in rows:
            codes = _codes(plain(text))
            if len(codes) >= LEAST:
                size = np.minimum(len(codes), [WINDOW, SHORT])
                (main if (_bound(size, Q) > 0).all() else small).append((item, codes))
            elif len(codes):
                short.append((item, plain(text)))
        out = cls._of(main, Q)
        out.small = cls._of(small, SMALL_Q) if small else None
        out.phrases = Phrases(short) if short else None
        return out

    @classmethod
    def _of(cls, rows: list[tuple[int | None, np.ndarray]], q: int) -> Windows:
        ids, texts = [item for item, _ in rows], [codes for _, codes in rows]
        lengths = np.array([len(t) for t in texts], "i8")
        sizes = np.stack([np.minimum(lengths, WINDOW), np.minimum(lengths, SHORT)])
        e = (EDITS * sizes).astype("i8")
        each = [grams(t, q) for t in texts]
        hashes = np.concatenate(each) if each else np.zeros(0, "u8")
        item = np.repeat(np.arange(len(texts), dtype="i4"), [len(g) for g in each]) if each else np.zeros(0, "i4")
        offset = np.concatenate([np.arange(len(g), dtype="i4") for g in each]) if each else np.zeros(0, "i4")
        order = np.argsort(hashes, kind="stable")
        keys, begin = np.unique(hashes[order], return_index=True)
        seen = np.zeros(1 << 22, bool)
        seen[(keys & np.uint64(len(seen) - 1)).astype("i8")] = True
        least = _bound(sizes, q)
        return cls(ids, texts, sizes, e, least, keys, np.append(begin, len(hashes)), item[order], offset[order], seen, q)

    def starts(self, item: int, size: int) -> np.ndarray:
        """Where the item's windows of this size start: at every word, every half WINDOW, and so that the last one ends with the item."""
        codes, last = self.codes[item], len(self.codes[item]) - size
        words = np.append(0, np.flatnonzero(codes == 32) + 1)
        return np.unique(np.concatenate([words[words < last], np.arange(0, max(1, last), WINDOW // 2), [last]]))

    @cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all items one after the other, and where each begins."""
        return np.concatenate(self.codes), np.cumsum([0, *map(len, self.codes)])

    @cached_property
    def places(self) -> list[np.ndarray]:
        """item << 32 | start of all longer and all shorter windows, in order."""
        return [
            np.concatenate([i << 32 | self.starts(i, int(size)).astype("i8") for i, size in enumerate(sizes)]) if len(sizes) else np.zeros(0, "i8")
            for sizes in self.sizes
        ]

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, list[int], int, int]]:
        """(item, size, edit budget, starts, first diagonal, end of diagonals) of the windows that reach their bound in a band."""
        found = grams(codes, self.q)
        places = np.flatnonzero(self.seen[(found & np.uint64(len(self.seen) - 1)).astype("i8")])
        if not len(places) or not len(self.keys):
            return
        k = np.minimum(np.searchsorted(self.keys, found[places]), len(self.keys) - 1)
        true = self.keys[k] == found[places]
        places, k = places[true], k[true]
        if not len(places):
            return
        n = self.begin[k + 1] - self.begin[k]
        post = np.repeat(self.begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, offset = self.item[post].astype("i8"), self.offset[post].astype("i8")
        # offsets are below shift, so this keeps diagonals and band numbers positive
        shift = max(map(len, self.codes))
        band = (np.repeat(places, n) - offset + shift) // (2 * self.budgets[0][item] + 1) + 1
        keys, offset = np.concatenate([item << 40 | band, item << 40 | (band - 1)]), np.append(offset, offset)
        # bands with too few shared grams go before the sort by offset
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        enough = count[inverse] >= self.least.min(axis=0)[keys >> 40]
        keys, offset = keys[enough], offset[enough]
        order = np.lexsort((offset, keys))
        keys, offset = keys[order], offset[order]
        item = keys >> 40
        for kind in (0, 1):
            size, least = self.sizes[kind][item], self.least[kind][item]
            upto = np.arange(len(keys)) + least - 1
            end = np.minimum(upto, len(keys) - 1)
            # so many grams from this one on lie in one window
            ok = (upto < len(keys)) & (keys[end] == keys) & (offset[end] - offset <= size - self.q)
            if kind:
                ok &= size < self.sizes[0][item]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            i, keyed = item[at], self.places[kind]
            low = np.searchsorted(keyed, i << 32 | np.maximum(0, offset[end[at]] - (size[at] - self.q)))
            high = np.searchsorted(keyed, i << 32 | offset[at], "right")
            # starts in any of the ranges low to high; both rise within a band
            fresh = np.append(True, np.diff(keys[at]) != 0)
            low = np.maximum(low, np.where(fresh, 0, np.append(0, high[:-1])))
            n = np.maximum(0, high - low)
            chosen = keyed[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] & (1 << 32) - 1
            upto = np.cumsum(np.add.reduceat(n, np.flatnonzero(fresh))).tolist()
            for key, a, b in zip(keys[at][fresh].tolist(), [0, *upto], upto):
                if a < b:
                    i, step = key >> 40, int(2 * self.budgets[0][key >> 40] + 1)
                    first = ((key & (1 << 40) - 1) - 1) * step - shift
                    yield i, int(self.sizes[kind][i]), int(self.budgets[kind][i]), chosen[a:b].tolist(), first, first + 2 * step

    def _all(self) -> Iterator[tuple[int, int, int, int]]:
        """(item, size, start, edit budget) of every window."""
        for i in range(len(self.ids)):
            for kind in (0, 1):
                size = int(self.sizes[kind][i])
                if not kind or size < self.sizes[0][i]:
                    yield from ((i, size, at, int(self.budgets[kind][i])) for at in self.starts(i, size).tolist())

    @property
    def texts(self) -> list[np.ndarray]:
        """The characters of every window."""
        return [self.codes[i][at : at + size] for i, size, at, _ in self._all()]

    @property
    def e(self) -> list[int]:
        """The edit budget of every window."""
        return [e for *_, e in self._all()]

    def occurs(self, w: tuple[int, int, int], text: np.ndarray, e: int, region: list[int]) -> bool:
        """Whether the window occurs somewhere in the region within its budget: one column of the alignment a step, as bits."""
        masks = self.masks.get(w)
        if masks is None:
            if len(self.masks) >= MEMO:
                self.masks.clear()
            masks = self.masks[w] = {}
            for i, c in enumerate(text.tolist()):
                masks[c] = masks.get(c, 0) | 1 << i
        n, get = len(text), masks.get
        every, last, score = (1 << n) - 1, 1 << (n - 1), n
        more, less = every, 0
        for c in region:
            same = get(c, 0)
            down = same | less
            across = (((same & more) + more) ^ more) | same
            up, low = less | ~(across | more), more & across
            if up & last:
                score += 1
            elif low & last:
                score -= 1
                if score <= e:
                    return True
            up, low = up << 1, low << 1
            more, less = (low | ~(down | up)) & every, up & down & every
        return False

    def possible(self, bands: Iterable[tuple[int, int, int, list[int], int, int]], codes: np.ndarray) -> Iterator[tuple[int, int, int, list[int], int, int]]:
        """The bands without the starts of neighbouring windows whose common part already takes too many edits."""
        for some in batched(bands, BLOCK):
            groups = []
            for n, (item, size, e, ats, first, end) in enumerate(some):
                k = 0
                while k < len(ats):
                    upto = bisect_right(ats, ats[k] + size // 3)
                    groups.append((n, k, upto, item, ats[upto - 1], ats[k] + size, e, first, end))
                    k = upto
            kept: list[list[int]] = [[] for _ in some]
            for at in range(0, len(groups), BLOCK):
                block = groups[at : at + BLOCK]
                for (n, k, upto, item, low, high, e, first, end), ok in zip(block, self._likely(block, codes)):
                    if not ok:
                        continue
                    region = codes[max(0, first + low - e) : max(0, end + high + e)]
                    if upto - k == 1 or self.occurs((item, high - low, low), self.codes[item][low:high], e, region.tolist()):
                        kept[n] += some[n][3][k:upto]
            for (item, size, e, _, first, end), ats in zip(some, kept):
                if ats:
                    yield item, size, e, ats, first, end

    def _likely(self, groups: list[tuple[int, ...]], codes: np.ndarray) -> list[bool]:
        """Whether the first 64 characters, at most, of each group's common part occur on its diagonals."""
        _, _, _, item, low, high, e, first, end = np.array(groups, "i8").T
        letters, begins = self.together
        sizes = np.minimum(high - low, 64)
        begin, of = begins[item] + low, np.arange(64)
        at = np.where(of < sizes[:, None], begin[:, None] + of, 0)
        # places beyond the texts hold no character
        begin, length = first + low - e, end - first + sizes + 2 * e
        places = begin[:, None] + np.arange(length.max())
        inside = (places >= 0) & (places < len(codes)) & (places < (begin + length)[:, None])
        regions = np.where(inside, codes[np.where(inside, places, 0)], np.uint32(0xFFFFFFFF))
        return within(letters[at], sizes, e, regions).tolist()

    def align(self, w: tuple[int, int, int], e: int, codes: np.ndarray, first: int, end: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best place of the window w, an (item, size, start), on the diagonals first to end, or None beyond its budget."""
        text = self.codes[w[0]][w[2] : w[2] + w[1]]
        from_, to = max(0, first), max(0, min(len(codes), end + len(text)))
        same = codes[from_:to].tobytes().find(text.tobytes())
        if same >= 0 and same % 4 == 0:
            return from_ + same // 4, from_ + same // 4 + len(text), 0
        if not self.occurs(w, text, e, codes[max(0, first - e) : max(0, end + len(text) + e)].tolist()):
            return None
        width = end - first + 2 * e
        steps = np.arange(width)
        padded = np.zeros(width + len(text), "u4")
        a, b = max(0, first - e), min(len(codes), first - e + len(padded))
        padded[a - first + e : b - first + e] = codes[a:b]
        # best[d]: edits of text[:i] against what ends on diagonal d; begun[d]: the diagonal where that starts
        best, begun = np.zeros(width, "i4"), steps.copy()
        for i in range(len(text)):
            kept = best + (padded[i : i + width] != text[i])
            dropped = np.append(best[1:], len(text)) + 1
            take = dropped < kept
            here = np.where(take, dropped, kept)
            source = np.where(take, np.append(begun[1:], 0), begun)
            level = here - steps
            lowest = np.minimum.accumulate(level)
            at = np.maximum.accumulate(np.where(level == lowest, steps, 0))
            best, begun = lowest + steps, source[at]
        d = int(best.argmin())
        if best[d] > e:
            return None
        return max(0, first - e + int(begun[d])), min(len(codes), first - e + d + len(text)), int(best[d])

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text, (item, start, end, edits) in characters of the text, one for each item that occurs."""
        codes, starts = plains(texts)
        out = self._search(texts, codes, starts)
        if self.small:
            out = [a + b for a, b in zip(out, self.small._search(texts, codes, starts))]
        if self.phrases:
            short = [[(item, *_source(t, a, b), 0) for item, a, b in self.phrases.search(plain(t))] if t else [] for t in texts]
            out = [a + b for a, b in zip(out, short)]
        return out

    def _search(self, texts: list[str], codes: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        found: list[dict[int, list[int]]] = [{} for _ in texts]
        done: dict[tuple[int, int, int, int], int] = {}

        def place(item: int, size: int, e: int, at: int, first: int, end: int) -> bool:
            """Whether the window occurs on these diagonals, in any of the texts that they cross."""
            i, any_ = int(np.searchsorted(starts, max(0, min(first + e, len(codes) - 1)), "right")) - 1, False
            while i < len(texts) and starts[i] < end + size:
                own, a, b = codes[starts[i] : starts[i + 1] - 1], first - int(starts[i]), end - int(starts[i])
                # a place that the overlapping band before has shown already; without one, nothing on any diagonal
                if a <= done.get((item, size, at, i), -(1 << 40)) < b:
                    any_ = True
                elif here := self.align((item, size, at), e, own, a, b):
                    any_ = True
                    done[item, size, at, i] = here[0]
                    old = found[i].setdefault(item, list(here))
                    found[i][item] = [min(old[0], here[0]), max(old[1], here[1]), min(old[2], here[2])]
                i += 1
            return any_

        for item, size, e, ats, first, end in self.possible(self.bands(codes), codes):
            k = 0
            while k < len(ats):
                if not place(item, size, e, ats[k], first + ats[k], end + ats[k]):
                    k += 1
                    continue
                # beyond a window that occurs, the furthest that does within half a window, then on from there
                last, far = k, bisect_right(ats, ats[k] + size // 2) - 1
                while far > last and not place(item, size, e, ats[far], first + ats[far], end + ats[far]):
                    far -= 1
                k = far if far > last else bisect_right(ats, ats[last] + size // 2)
        return [[(self.ids[item], *_source(t, a, b), e) for item, (a, b, e) in sorted(hits.items())] if hits else [] for t, hits in zip(texts, found)]


def _source(text: str, start: int, end: int) -> tuple[int, int]:
    """The characters of the text that plain(text)[start:end] comes from."""
    at, first, last = 0, None, 0
    for m in _KEPT.finditer(text):
        size = len(m[0].lower())
        if first is None and start < at + size:
            first = m.start() + min(max(0, start - at), len(m[0]))
        if at >= end:
            break
        last = m.start() + min(end - at, len(m[0]))
        at += size + 1
    return first or 0, max(first or 0, last)


def _parts(benchmark: DataFrame, item_id: str, text: str) -> Iterator[DataFrame]:
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PART_CHARS)
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)


def hits(text: Column, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Column:
    """array<struct<item_id, start, end, edits>> of each whole text: every item of which a window occurs."""
    found = F.array().cast(HITS)
    for part in _parts(benchmark, item_id, item_text):
        shared = benchmark.sparkSession.sparkContext.broadcast(Windows.of((r["item_id"], r["text"]) for r in part.toLocalIterator()))
        found = F.concat(found, _search(shared)(text))
    return found


def _search(shared):
    @F.arrow_udf(HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = shared.value
        for batch in batches:
            rows, chunk, size = [], [], 0
            for value in batch:
                chunk.append(value.as_py())
                size += len(chunk[-1] or "")
                if size >= CHUNK:
                    rows += windows.search(chunk)
                    chunk, size = [], 0
            rows += windows.search(chunk) if chunk else []
            flat = [h for row in rows for h in row]
            offsets = np.cumsum([0, *map(len, rows)]).astype("i4")
            columns = [pa.array([h[i] for h in flat], f.type) for i, f in enumerate(_HIT)]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_HIT)))

    return search


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows without any hit, with the columns they came with."""
    return docs.where(F.size(hits(F.col(text), benchmark)) == 0)
