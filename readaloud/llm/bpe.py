"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is the concatenation of its pattern matches, and each match is encoded
on its own. A match is a balanced tree: leaves of a few bytes are merged
directly, and two neighbours are joined by re-encoding a window of tokens
around their boundary, doubled on the side that is not yet stable. A side is
stable when its outermost new token and the untouched token next to it, encoded
together, come back as the same two tokens: a token sequence is the encoding
of its bytes exactly if every adjacent pair is, so nothing outside the window
can change. Joining is associative with the empty sequence as identity.
Decoding looks up every id and concatenates.

Rows never move: both directions run in Arrow batches inside the scan's own
partitions. Recurring short matches are looked up in a table of bounded size.

Edge cases: a null text is the empty text (no ids); ids travel as
little-endian unsigned 32-bit integers; repeated rows are encoded one by one;
an empty table gives an empty result; columns other than the id and the text
are ignored, so clashing names don't matter.
"""
from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

LEAF = 64
HEAP_FROM = 48
CACHED_PIECES = 800_000
CACHED_PAIRS = 200_000
CACHED_CHARS = 24
BATCH_BYTES = 8 << 20
NO_RANK = 1 << 40


class Codec:
    """Encoder and decoder for one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        return self._merge_scan(data) if len(data) < HEAP_FROM else self._merge_heap(data)

    def _merge_scan(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        at = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while at and (low := min(at)) < NO_RANK:
            i = at.index(low)
            joined = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], at[i]
            if i:
                at[i - 1] = rank(parts[i - 1] + joined, NO_RANK)
            if i < len(at):
                at[i] = rank(joined + parts[i + 1], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        """The same with linked neighbours and a heap, for long windows."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i] or end[i] == n or end[end[i]] != stop:
                continue
            j = end[i]
            live[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the concatenation, from the encodings of both sides."""
        if not a or not b:
            return a + b
        left = right = 1
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a[i:] + b[:j])))
            left_ok = i == 0 or self.stable(a[i - 1], window[0])
            right_ok = j == len(b) or self.stable(window[-1], b[j])
            if left_ok and right_ok:
                return a[:i] + window + b[j:]
            left, right = left if left_ok else 2 * left, right if right_ok else 2 * right

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.merge(data)
        parts = [self.merge(data[i:i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(parts) > 1:  # one level of the tree at a time
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class _Pieces(dict):
    """Encoded short matches; emptied when full, so its memory is bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.codec.encode_piece(piece.encode()))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _mapped(batches: Iterator[pa.RecordBatch], convert, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Replace the second column by ``convert`` of it, in batches of bounded size."""
    for batch in batches:
        ids, values, out, size, start = batch.column(0), batch.column(1), [], 0, 0
        for k, v in enumerate(values):
            out.append(convert(v.as_py()))
            size += len(out[-1])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array(out, kind)], names)
                out, size, start = [], 0, k + 1
        if out:
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array(out, kind)], names)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text, as little-endian unsigned 32-bit integers."""
    def run(batches):
        c = codec(rank_file, pattern)
        return _mapped(batches, lambda t: c.encode(t or ""), pa.binary(), [id_col, "ids"])
    rows = shipped(docs.select(id_col, text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for."""
    kind = tokens.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", "decoded"]

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            start, size, out = 0, 0, []
            for k, v in enumerate(batch.column(1)):
                ids = v.as_py() or b""
                out.append(c.decode(ids))
                size += len(out[-1]) + len(ids)
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names)
                    start, size, out = k + 1, 0, []
    return shipped(tokens.select(id_col, "ids")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, per document."""
    both = decode_ids(encode_documents(docs, rank_file, pattern), rank_file, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
