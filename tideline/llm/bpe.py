"""Byte-level BPE by dynamic programming over prefixes.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their own
bytes, so each prefix of a piece has one valid last token. Storing that token per byte gives the encoding by
walking back, lets bytes be appended without touching what is there, and bounds the work of an edit: behind it,
positions are computed anew only until as many last tokens as the longest token has bytes agree with the old ones.

A text is cut by the pattern first and each match is encoded separately; a match that is itself a token is that
token. Null counts as the empty text, which has no tokens. Long texts are encoded whole; the work per byte is
bounded by the longest token. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of each memo of a task before it starts anew. Memos only save work.
MEMO = 400_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        self._ordered = True
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merged(self, data: bytes, trace: list[tuple[bytes, bytes]] | None = None) -> list[int]:
        """The encoding by its definition: join the neighbours of lowest rank, leftmost first. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            if trace is not None:
                trace.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks.get(p, -1) for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes a token; (token, token) for a single byte; None if joins never make it."""
        known = self._halves.get(token, 0)
        if known == 0:
            data, trace = self.tokens[token], []
            if len(data) == 1:
                known = (token, token)
            elif self.merged(data, trace) == [token]:
                known = tuple(self.ranks.get(p, -1) for p in trace[-1])
                if max(known) >= token:  # joins are then not in order of rank, and valid() goes by the definition
                    self._ordered = False
            else:
                known = None
            self._halves[token] = known
        return known

    def _joined(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' bytes joins across them: undoes their joins, latest first.

        The neighbours a and b at the border are joined if that join ranks before the ones that absorb a or b;
        at equal rank the one further left comes first.
        """
        a, b, a_until, b_until = left, right, 1 << 62, 1 << 62
        tokens, ranks = self.tokens, self.ranks
        while True:
            rank = ranks.get(tokens[a] + tokens[b])
            if rank is not None and rank < a_until and rank <= b_until:
                return True
            a_join = a if len(tokens[a]) > 1 else -1
            b_join = b if len(tokens[b]) > 1 else -1
            if a_join < 0 and b_join < 0:
                return False
            if a_join > b_join:
                a_until, a = a, self.halves(a)[1]
            else:
                b_until, b = b, self.halves(b)[0]

    def valid(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side; left is -1 at the start of a piece."""
        if self.halves(right) is None:
            return False
        if left < 0:
            return True
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            if self._ordered:
                known = not self._joined(left, right)
            if not self._ordered:
                known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self._pairs[key] = known
        return known

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> None:
        """Appends the one valid last token of each prefix of data that last doesn't have yet."""
        ranks, pairs, valid, longest, put = self.ranks.get, self._pairs.get, self.valid, self.longest, last.append
        for end in range(len(last), (len(data) if until is None else until) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = ranks(data[start:end])
                if token is not None:
                    before = last[start]
                    known = pairs(before << 32 | token) if before >= 0 else None
                    if known or known is None and valid(before, token):
                        put(token)
                        break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces. In sorted order each one appends to what it shares with the one before."""
        out, before, last = {}, b"", [-1]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            shared = 0
            for x, y in zip(data, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            before = data
            self.extend(data, last)
            out[piece] = np.array(self.walk(data, last), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        fresh = {p for pieces in cut for p in pieces if p not in self._pieces}
        if len(self._pieces) + len(fresh) > MEMO:
            self._pieces = {}
            fresh = {p for pieces in cut for p in pieces}
        self._pieces |= self._learn(fresh)
        known = self._pieces.__getitem__
        out = [b"".join(map(known, pieces)) for pieces in cut]
        for piece in fresh:
            if len(piece) > 64:
                del self._pieces[piece]
        return out

    def encode_stream(self, texts: Iterable[str], size: int = 2_000_000) -> Iterator[bytes]:
        """encode() over portions of about that many characters, so that memory stays bounded."""
        portion, chars = [], 0
        for text in texts:
            portion.append(text)
            chars += len(text)
            if chars >= size:
                yield from self.encode(portion)
                portion, chars = [], 0
        yield from self.encode(portion)

    def forget(self) -> None:
        """Drops the memos, so that a worker that goes on to other work keeps the vocabulary alone."""
        self._pieces, self._pairs = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Prefixes:
    """The valid last token of every prefix of one piece, kept up to date under appends and edits."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many prefixes were computed anew."""
        old, moved = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, end = old[: start + 1], 0, start
        clean = start + len(new) + self.bpe.longest
        while end < len(self.data):
            end += 1
            self.bpe.extend(self.data, self.last, end)
            unchanged = end > clean and end - moved > self.bpe.longest and old[end - moved] == self.last[end]
            same = same + 1 if unchanged else 0
            if same > self.bpe.longest:
                self.last += old[end - moved + 1 :]
                break
        return end - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.data, self.last)


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The vocabulary, read once by each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of each whole text as packed little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path, pattern)
        try:
            for batch in batches:
                yield pa.array(bpe.encode_stream(t.as_py() or "" for t in batch), pa.binary(), size=len(batch))
        finally:
            bpe.forget()

    return ids(text)


def encode_checked(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, decodes>: encode() and whether decoding gives the text again, both by one worker with one vocabulary."""
    kind = pa.struct([("ids", pa.binary()), ("decodes", pa.bool_())])

    @F.arrow_udf("struct<ids: binary, decodes: boolean>")
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path, pattern)
        try:
            for batch in batches:
                ids, same = [], []
                for t, packed in zip(batch, bpe.encode_stream(t.as_py() or "" for t in batch)):
                    ids.append(packed)
                    same.append(bpe.decode(packed) == (t.as_py() or "").encode())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], fields=list(kind))
        finally:
            bpe.forget()

    return checked(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that packed ids stand for; null ids give no bytes."""

    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path, pattern)
        for batch in batches:
            yield pa.array((bpe.decode(t.as_py() or b"") for t in batch), pa.binary(), size=len(batch))

    return data(ids)


def id_list(ids: Column) -> Column:
    """Packed ids as array<int>, for callers that want them unpacked."""

    @F.arrow_udf("array<int>")
    def unpacked(packed: pa.Array) -> pa.Array:
        rows = [np.frombuffer(p.as_py() or b"", "<u4").astype("i4") for p in packed]
        offsets = np.cumsum([0, *map(len, rows)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, "i4")))

    return unpacked(ids)
