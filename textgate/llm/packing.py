"""Token-id output: documents packed into fixed-length rows by best-fit decreasing.

Documents longer than a row are split without loss; pieces are sorted by length and each goes to the row with the least
room that still fits, found in a segment tree over capacities. A packed row holds an id matrix row (unsigned 32-bit,
padded), the cumulative lengths of its pieces and position ids that start anew with each piece. Packing runs in groups of
documents, dealt by a hash of id and text; there are as many groups as make about GROUP_BYTES of text each, so rows depend neither
on an unbounded set nor on how the table is partitioned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import arrow_map, slices

ROW_TOKENS = 2048
PAD = 50256
#: Bytes of text that are packed together.
GROUP_BYTES = 1 << 22
PACKED_SCHEMA = "row_tokens int, n_tokens int, n_segments int, doc_ids array<bigint>, part_of array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks; a worker reads it once. Special tokens' strings in a text are ordinary text."""
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Rooms:
    """A segment tree over capacities 0 .. most: how many open rows have each. fit(n) finds the smallest that is n at least."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def fit(self, n: int) -> int:
        """The smallest capacity >= n that an open row has, or -1."""
        i = n + self.width
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Rows of piece numbers; lengths are at most room. Ties: the earlier piece first. Empty pieces are left out."""
    rooms, rows = Rooms(room), []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
        at = rooms.fit(lengths[i])
        if at < 0:
            row, at = len(rows), room
            rows.append([])
        else:
            row = rooms.take(at)
        rows[row].append(i)
        if at > lengths[i]:
            rooms.add(at - lengths[i], row)
    return rows


def split(ids: np.ndarray, room: int) -> list[np.ndarray]:
    return [ids[i : i + room] for i in range(0, len(ids), room)]


def pack_group(docs: list[tuple[int, np.ndarray]], room: int = ROW_TOKENS, pad: int = PAD) -> list[tuple]:
    """Packed rows of (doc_id, ids) pairs."""
    pieces = [(d, k, p) for d, ids in docs for k, p in enumerate(split(ids, room))]
    out = []
    for row in best_fit_decreasing([len(p) for _, _, p in pieces], room):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0, *(len(p) for _, _, p in own)])
        ids = np.full(room, pad, "<u4")
        ids[: ends[-1]] = np.concatenate([p for _, _, p in own])
        places = np.zeros(room, "<u4")
        places[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        out.append((room, int(ends[-1]), len(own), [d for d, _, _ in own], [k for _, k, _ in own], ends.tolist(), ids.tobytes(), places.tobytes()))
    return out


def pack(docs: DataFrame, path: str, room: int = ROW_TOKENS) -> DataFrame:
    """Packed rows of the texts of docs (PACKED_SCHEMA): every token of every text is in one place, in order within its
    piece; part_of says which piece of the document it is. Null and empty texts have no piece; documents with equal ids
    are packed as separate documents, and texts longer than a row are split. path: a file of token ranks. Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        held: list[tuple[int, np.ndarray]] = []
        now = None

        def emit() -> pa.RecordBatch:
            rows = pack_group(held, room)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = [x.split()[0] for x in PACKED_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for part in slices(batch, "text"):
                for g, d, t in zip(*(part.column(c).to_pylist() for c in ("_group", "doc_id", "text")), strict=True):
                    if held and g != now:
                        yield emit()
                        held = []
                    now = g
                    held.append((d, np.array(own.encode_ordinary(t or ""), "<u4")))
        if held:
            yield emit()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // GROUP_BYTES + 1))
    dealt = docs.select(group.alias("_group"), "doc_id", "text", F.xxhash64("text").alias("_hash")).repartition("_group").sortWithinPartitions("_group", "doc_id", "_hash")
    return arrow_map(dealt.select("_group", "doc_id", "text"), run, PACKED_SCHEMA)


def write_packed(docs: DataFrame, path: str, out: str, room: int = ROW_TOKENS) -> None:
    """Write packed rows as Parquet; readers map input_ids and position_ids as (rows, room) unsigned 32-bit matrices."""
    pack(docs, path, room).write.parquet(out)


def summaries(packed: DataFrame) -> DataFrame:
    """A row per packed row, with digests in place of the matrices' bytes: what the query shows."""
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return packed.select("row_tokens", "n_tokens", "n_segments", "doc_ids", "part_of", "cu_seqlens", sha("input_ids"), sha("position_ids"))
