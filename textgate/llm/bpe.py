"""BPE encoding and decoding by speculation.

A piece (what the byte-level pattern splits off) is first cut by greedy longest match. A cut is the BPE encoding if and
only if each adjacent pair of its tokens is compatible: encoding the two tokens' bytes alone gives back the two tokens.
(If a merge crossed a boundary, the first such would also happen in the pair alone.) The pairs of many pieces are tested
at once against sorted arrays of known verdicts; only pieces with a failing pair are merged exactly, by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

#: The byte-level pattern of the public tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded chunks, and pieces, that a task keeps in each of two generations; beyond it the older one goes.
MEMO = 300_000
#: Bytes of text whose unknown pieces are learned together.
LEARN_BYTES = 2_000_000
NEVER = (1 << 60, -1)
#: White space other than blank and line feed, and the mark that splitting uses.
ODD_SPACE = {c for i in range(0x3001) if (c := chr(i)).isspace() or not i} - {" ", "\n"}
HIGH = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A hash table from non-negative integers to integers, read many keys at a time; -1 for what it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.mask
            there, want = self.keys[slot], keys[on]
            hit = there == want
            out[on[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            on, slot = on[more], slot[more]
        return out


class Codec:
    """Encoder and decoder of one byte-level BPE file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        added = spec.get("added_tokens", [])
        self.special = {a["content"]: a["id"] for a in added}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.longest = max(map(len, self.ids))
        self.pieces = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.made = np.array([made for _, made in self.rank.values()], np.int64)
        self.pair_rank = Table(np.array([a * size + b for a, b in self.rank], np.int64), np.arange(len(self.rank)))
        self.one_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        nodes: dict[int, int] = {}
        ends_at: dict[int, int] = {}
        for b, i in self.ids.items():
            node = 0
            for x in b:
                node = nodes.setdefault(node << 8 | x, len(nodes) + 1)
            ends_at[node] = i
        self.trie = Table(np.fromiter(nodes, np.int64), np.fromiter(nodes.values(), np.int64))
        self.node_token = np.full(len(nodes) + 1, -1, np.int64)
        self.node_token[list(ends_at)] = list(ends_at.values())
        self.one = [self.ids[bytes([b])] for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.memo_before: dict[str, bytes] = {}
        self.exact = 0  # pieces merged exactly so far
        self.size = size

    def merge(self, piece: bytes) -> list[int]:
        """The exact encoding: the lowest-ranked adjacent pair merges first, leftmost of equals. O(n log n)."""
        if len(piece) <= 40:
            return self.merge_short(piece)
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heapq.heapify(heap)
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.rank:
                    r, made = self.rank[p]
                    heapq.heappush(heap, (r, x, made, *p))
        return [t for t in ids if t >= 0]

    def merge_short(self, piece: bytes) -> list[int]:
        """As merge(), quadratic and without a heap."""
        ids, of = [self.one[b] for b in piece], self.rank.get
        ranks = [of(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = of((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = of((ids[i], ids[i + 1]), NEVER)
        return ids

    def greedy(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match cuts of all pieces in step: (tokens one after the other, where each piece's end)."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8).astype(np.int64)
        base = np.cumsum(n) - n
        found_piece, found_token = [], []
        piece, at, end = np.arange(len(raw)), base.copy(), base + n
        node, depth, best, took = (np.zeros(len(raw), np.int64) for _ in range(4))
        while len(piece):
            to = at + depth
            step = self.trie.get(node << 8 | text[to])
            step[to >= end] = -1
            on = step >= 0
            node = np.where(on, step, 0)
            depth = np.where(on, depth + 1, 0)
            token = self.node_token[node]
            better = on & (token >= 0)
            best = np.where(better, token, best)
            took = np.where(better, depth, took)
            stop = ~on
            if stop.any():
                found_piece.append(piece[stop])
                found_token.append(best[stop])
                at = np.where(stop, at + took, at)
                keep = at < end
                if not keep.all():
                    piece, at, end, node, depth, best, took = (x[keep] for x in (piece, at, end, node, depth, best, took))
        owner = np.concatenate(found_piece)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found_token)[order], np.cumsum(np.bincount(owner, minlength=len(raw)))

    def merge_many(self, raw: list[bytes]) -> list[list[int]]:
        """merge() of many pieces in step: each round merges the lowest-ranked, leftmost pair of every piece."""
        out: list[list[int]] = [[]] * len(raw)
        for some in np.array_split(np.argsort([len(b) for b in raw], kind="stable"), len(raw) // 4096 + 1):
            own = [raw[i] for i in some]
            if not own:
                continue
            if len(own[-1]) > 40:
                for i, b in zip(some.tolist(), own, strict=True):
                    out[i] = self.merge(b)
                continue
            n, wide = np.array([len(b) for b in own]), len(own[-1]) + 1
            ids = np.full((len(own), wide), -1, np.int64)
            ids[np.arange(wide) < n[:, None]] = self.one_ids[np.frombuffer(b"".join(own), np.uint8)]
            rank = np.full((len(own), wide), HIGH, np.int64)
            rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
            live, cols = np.arange(len(own)), np.arange(wide - 1)
            while len(live):
                j = rank[live].argmin(1)
                low = rank[live, j]
                live, j, low = live[low < HIGH], j[low < HIGH], low[low < HIGH]
                if not len(live):
                    break
                gap = cols[None, :] > j[:, None]
                a, r = ids[live], rank[live]
                a[:, :-1] = np.where(gap, a[:, 1:], a[:, :-1])
                r[:, :-1] = np.where(gap, r[:, 1:], r[:, :-1])
                row = np.arange(len(live))
                a[row, j] = self.made[low]
                r[row, j] = self.ranks(a[row, j], a[row, np.minimum(j + 1, wide - 1)])
                has = j > 0
                r[row[has], j[has] - 1] = self.ranks(a[row[has], j[has] - 1], a[row[has], j[has]])
                ids[live], rank[live] = a, r
                n[live] -= 1
            for i, k, x in zip(some.tolist(), n.tolist(), ids.tolist(), strict=True):
                out[i] = x[:k]
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; HIGH if there is none."""
        got = self.pair_rank.get(np.where((a < 0) | (b < 0), -2, a * self.size + b).ravel()).reshape(a.shape)
        got[got < 0] = HIGH
        return got

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Verdict for each pair (left id * size + right id); unknown pairs are settled once by the exact merge."""
        fresh = np.setdiff1d(pairs, self.pair_keys)
        if len(fresh):
            both = fresh.tolist()
            made = self.merge_many([self.bytes[p // self.size] + self.bytes[p % self.size] for p in both])
            ok = np.array([m == [p // self.size, p % self.size] for m, p in zip(made, both, strict=True)], bool)
            keys = np.concatenate([self.pair_keys, fresh])
            order = np.argsort(keys)
            self.pair_keys, self.pair_ok = keys[order], np.concatenate([self.pair_ok, ok])[order]
        return self.pair_ok[np.searchsorted(self.pair_keys, pairs)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known yet: propose, verify all at once, merge the failing ones exactly."""
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        flat, ends = self.greedy(raw)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False  # no pair across pieces
        ok = np.ones(len(inner), bool)
        if inner.any():
            ok[inner] = self.compatible(flat[:-1][inner] * self.size + flat[1:][inner])
        data, to = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        self.known.update((p, data[i:j]) for p, i, j in zip(pieces, [0, *to], to))
        failing = np.unique(np.searchsorted(ends, np.flatnonzero(~ok), "right")).tolist()
        for i, ids in zip(failing, self.merge_many([raw[i] for i in failing]), strict=True):
            self.known[pieces[i]] = np.array(ids, "<u4").tobytes()
        self.exact += len(failing)

    def odd(self, text: str) -> bool:
        """Whether white space stands at an end, next to other white space, or is anything but blanks and line feeds."""
        return text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not ODD_SPACE.isdisjoint(text)

    def chunks(self, text: str) -> list[str]:
        """Parts that encode independently. Where white space is only single blanks and line feeds inside the text, a
        piece always ends before each of them, so the parts are found by splitting alone; else the pattern runs."""
        if self.odd(text):
            return self.pieces(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo, self.memo_before = {}, self.memo
        if len(self.known) > MEMO:
            self.known, self.known_before = {}, self.known
        parts: list[list] = []
        for text in texts:
            if self.around and any(s in text for s in self.special):
                parts.append([x for i, t in enumerate(self.around.split(text)) for x in ([t] if i % 2 else self.chunks(t) if t else [])])
            else:
                parts.append(self.chunks(text) if text else [])
        fresh = set().union(*parts).difference(self.memo)
        kept = fresh.intersection(self.memo_before)
        self.memo.update(zip(kept, map(self.memo_before.__getitem__, kept)))
        fresh -= kept
        split = {c: [c] if c.isascii() and (c[1:] if c[0] == " " else c).isalpha() else self.pieces(c) for c in fresh if c not in self.special}
        known, wanted = self.known, set().union(*split.values()).difference(self.known)
        kept = wanted.intersection(self.known_before)
        known.update(zip(kept, map(self.known_before.__getitem__, kept)))
        self.learn(list(wanted - kept))
        self.memo.update((c, b"".join([known[p] for p in ps])) for c, ps in split.items())
        self.memo.update((c, np.array([self.special[c]], "<u4").tobytes()) for c in fresh if c in self.special)
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def forget(self) -> None:
        """Drop all remembered chunks and pieces; verdicts on pairs stay."""
        self.known, self.known_before, self.memo, self.memo_before = {}, {}, {}, {}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file; a worker reads it once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit) and n_tokens of each row of docs.

    Rows are independent and keep their number and partitioning; repeated rows give repeated results. Null and empty
    texts have no ids. Other columns are ignored. An empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text", LEARN_BYTES):
                ids = own.encode_all([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64())], ["key", "ids", "n_tokens"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return arrow_map(narrow, run, f"key {kind}, ids binary, n_tokens bigint", lambda: codec(path).forget()).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key and text of each row of (key, ids); null ids give an empty text. Invalid UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([own.decode(b or b"") for b in batch.column("ids").to_pylist()], pa.string())], ["key", "text"])

    narrow = encoded.select(F.col(key).alias("key"), "ids")
    kind = narrow.schema["key"].dataType.simpleString()
    return arrow_map(narrow, run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again.

    Both steps run in one pass, so ids never leave the worker. Null text counts as empty; repeated doc_ids stay apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text", LEARN_BYTES):
                ids = own.encode_all([t or "" for t in part.column("text").to_pylist()])
                back = [own.decode(b) for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(b) // 4 for b in ids], pa.int64()),
                        pa.array([sha(b).hexdigest() for b in ids]),
                        pa.array([sha(t.encode()).hexdigest() for t in back]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda: codec(path).forget())
