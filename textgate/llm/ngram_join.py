"""N-gram Jaccard self-join by signature trees: documents whose sets of 5-word shingles have Jaccard 0.8 or more.

1. profiles(): each text's shingle set as size, 64-bit key (equal sets have equal keys, so copies are one member from here
   on) and bitmap. Common shingles of a batch are counted along the way.
2. postings(): two sets of Jaccard 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, in any fixed order of
   shingles. The order is by hash, with common shingles last, rarer ones of these first; it affects speed only, but large
   blocks are mostly avoided by it, at any number of documents. Postings are sorted in ranges by
   (shingle, size, set), which split a frequent shingle, and read as streams. The sets of a shingle are a block; those that one
   set alone has are dropped, equal blocks are one. A block of more than BLOCK sets, or over a range's edge, is a star of
   candidate links instead: more candidates, none lost.
3. In each block a signature tree (nodes hold the OR of their members' bitmaps, a size range and the fewest bits) is
   traversed against itself; node pairs whose maximum possible overlap is too small are pruned, as are those that are
   already connected. This leaves a forest of candidate links, whose components are groups.
4. Each group's whole shingle sets meet in one task and the same traversal, now with exact intersections at the leaves, gives the
   true links' forest and so the components. A group of more than 2 * PART sets is dealt in parts of PART, with HUBS of its
   sets in each; what they don't connect with the group's largest component (REST) then meets all of the group in
   parts of REST_PART. Copies of one text so cost what their number does; only sets that are linked with no hub cost their
   number times that of the parts.

Shingles and sets are compared by 64-bit hashes. No table of documents or links is collected or broadcast; what is
broadcast are the COMMON most frequent shingles, and what is collected are those and a row of each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, discard, gathered, give_back, mix, shingles, slices, text_buffer, words, written

#: A shingle is common if several sets of a batch have it, as one of the batch's BATCH_COMMON most frequent ones; by their counts in all
#: batches, so many are ordered last.
BATCH_COMMON, COMMON = 1 << 16, 1 << 18
#: Text bytes whose shingles are counted together.
COUNT_BYTES = 16_000_000
#: Members of a block that are compared by their bitmaps.
BLOCK = 512
#: Members of a part of a large group, of those that are in each of its parts, and of a part that meets the rest.
PART, HUBS, REST_PART = 256, 16, 2048
LEAF = 8
#: Remainders of hashes by which documents are sieved before they are shuffled: a broadcast of 4 MB at most.
SIEVE = 1 << 18


def linked(both: int, a: int, b: int) -> bool:
    """100 * intersection >= 80 * union, by sizes."""
    return 9 * both >= 4 * (a + b)


def shingle_sets(part: pa.RecordBatch, text: str = "text") -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    _, hashes, bounds = words(*text_buffer(part.column(text)))
    got, out = shingles(hashes, bounds)
    return [np.unique(got[a:b]) for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)]


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each shingle, in the next power of two of twice their number (64 at least) of bits."""
    wide = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(wide, np.uint8)
    bits[(tokens & np.uint64(wide - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def often(shingle: np.ndarray, count: np.ndarray, most: int = BATCH_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Those that several sets have, at most `most` of them: the most frequent."""
    at = np.flatnonzero(count > 1)
    if len(at) > most:
        at = at[np.argpartition(count[at], -most)[-most:]]
    return shingle[at], count[at]


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key, n, bits and (in a few rows) common: pairs of a common shingle and its count in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", COUNT_BYTES):
            for large in slices(batch, "text", COUNT_BYTES):
                sets = [s for part in slices(large, "text") for s in shingle_sets(part)]
                keys = [set_key(s) for s in sets]
                once = {k: s for k, s in zip(keys, sets, strict=True) if len(s)}
                shingle, count = np.unique(np.concatenate(list(once.values())), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                shingle, count = often(shingle, count)
                pairs = pa.StructArray.from_arrays([pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))], ["shingle", "n"])
                common = pa.ListArray.from_arrays(pa.array([0] + [len(shingle)] * len(sets), pa.int32()), pairs)
                bits = {k: bitmap(s) for k, s in once.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        large.column("doc_id"), large.column("text_hash"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bits.get(k) for k in keys], pa.binary()),
                        common,
                    ],
                    ["doc_id", "text_hash", "key", "n", "bits", "common"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return arrow_map(rows, run, "doc_id bigint, text_hash bigint, key bigint, n bigint, bits binary, common array<struct<shingle: bigint, n: bigint>>")


def common_shingles(profiled: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the common shingles, ascending, and the place of each in order of frequency: at most `most`, so 3 MB."""
    counted = written(profiled.select(F.explode("common").alias("c")).groupBy("c.shingle").agg(F.sum("c.n").alias("n")), "common")
    held, least = 0, None  # the smallest count that few enough shingles reach, so that no task sorts them all
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("many")).collect(), reverse=True):
        held += r.many
        if held > most:
            break
        least = r.n
    rows = counted.where(F.col("n") >= (1 << 62 if least is None else least)).orderBy(F.desc("n"), "shingle").toArrow()
    discard(counted)
    shingle = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    give_back()
    return shingle[order], np.arange(len(shingle) - 1, -1, -1, dtype=np.int32)[order]


def first_of(tokens: np.ndarray, p: int, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first p of a set's shingles in the global order: by hash, then the common ones (last) by their places."""
    if not len(last) or len(tokens) <= p:
        return tokens[:p]
    at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
    is_last = last[at] == tokens
    head = tokens[~is_last][:p]
    if len(head) == p:
        return head
    common = tokens[is_last]
    return np.concatenate([head, common[np.argsort(place[at[is_last]])[: p - len(head)]]])


def postings(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """shingle, key, n: the prefix of each distinct set. A task emits a set once, as far as it remembers."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, place), seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                heads, keys = [], []
                for s in shingle_sets(part):
                    if not len(s) or (k := set_key(s)) in seen:
                        continue
                    seen.add(k)
                    p = prefix(len(s))
                    heads.append(first_of(s, p, last, place))
                    keys.append((k, len(s), p))
                if len(seen) > 1_000_000:
                    seen.clear()
                if heads:
                    k, n, p = (np.array(x, np.int64) for x in zip(*keys, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(k, p)), pa.array(np.repeat(n, p).astype(np.int32))], ["shingle", "key", "n"])

    return arrow_map(docs.select("text"), run, "shingle bigint, key bigint, n int")


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Of batches in which equal values of `by` follow one another: tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(by).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(value[1:] != value[:-1])
        if held and held[-1].column(by)[-1].as_py() != value[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class BlockReader:
    """Reads postings (shingle, key, n) in order of shingle, n and key; memory: a batch and BLOCK postings.

    What it gives: blocks, as (name, keys, sizes), and stars, as (keys, hub). Shingles at the edges of a range are stars, as their
    other postings may be in the next range.
    """

    def __init__(self) -> None:
        self.seen: set[int] = set()
        self.first: list[int] | None = None  # shingle and hub of the range's first shingle
        self.shingle: int | None = None
        self.hub, self.large, self.keys, self.sizes = 0, False, [], []

    def add(self, shingle: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[list, list]:
        blocks: list[tuple[int, np.ndarray, np.ndarray]] = []
        stars: list[tuple[np.ndarray, int]] = []
        fresh = np.append([True], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        shingle, key, n = shingle[fresh], key[fresh], n[fresh]
        begin = np.flatnonzero(np.append([True], shingle[1:] != shingle[:-1]))
        ends = np.append(begin[1:], len(shingle))
        some = ends - begin > 1  # one posting is no block, but the first and last may go on in other batches
        some[[0, -1]] = True
        begin, ends = begin[some], ends[some]
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            if self.shingle != int(shingle[a]):
                self.close(blocks)
                self.shingle, self.hub, self.keys, self.sizes = int(shingle[a]), int(key[a]), [], []
                self.large = self.first is None
                if self.first is None:
                    self.first = [self.shingle, self.hub]
            if self.large:
                stars.append((key[a:b], self.hub))
                continue
            self.keys.append(key[a:b])
            self.sizes.append(n[a:b])
            if sum(map(len, self.keys)) > BLOCK:
                stars += [(k, self.hub) for k in self.keys]
                self.large, self.keys, self.sizes = True, [], []
        return blocks, stars

    def close(self, blocks: list) -> None:
        """The block of the shingle that has ended."""
        if self.large or not self.keys:
            return
        keys, sizes = np.concatenate(self.keys), np.concatenate(self.sizes)
        once = np.append([True], keys[1:] != keys[:-1])
        keys, sizes = keys[once], sizes[once]
        name = int(mix(keys.view(np.uint64)).sum())
        if len(keys) > 1 and name not in self.seen:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            self.seen.add(name)
            blocks.append((name, keys, sizes))

    def end(self) -> tuple[list, list[int]]:
        """(stars of the last shingle, the first shingle and its hub, the last shingle and its hub)."""
        return [(k, self.hub) for k in self.keys], [*self.first, self.shingle, self.hub]


def blocks(posted: DataFrame) -> DataFrame:
    """block, key, n, hub, edge, as a written table: members of blocks (hub null), spokes of stars (block null), and one row a range with
    its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = BlockReader(), 0
        names, kinds = ["block", "key", "n", "hub", "edge"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

        def shown(found: list, stars: list) -> Iterator[pa.RecordBatch]:
            if found:
                key = np.concatenate([k for _, k, _ in found])
                block = np.repeat(np.array([x for x, _, _ in found], np.uint64).view(np.int64), [len(k) for _, k, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(key), pa.array(np.concatenate([n for _, _, n in found]), pa.int32()), *[pa.nulls(len(key), k) for k in kinds[3:]]], names)
            pairs = [(k[k != h], h) for k, h in stars]
            key = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.int64)
            if len(key):
                hub = np.repeat(np.array([h for _, h in pairs], np.int64), [len(k) for k, _ in pairs])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), kinds[0]), pa.array(key), pa.nulls(len(key), kinds[2]), pa.array(hub), pa.nulls(len(key), kinds[4])], names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                yield from shown(*reader.add(*(batch.column(c).to_numpy() for c in ("shingle", "key", "n"))))
        if reader.first:
            stars, edge = reader.end()
            yield from shown([], stars)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds[:4]], pa.array([[part, *edge]], kinds[4])], names)

    order = ["shingle", "n", "key"]
    ranged = posted.repartitionByRange(*order).sortWithinPartitions(*order).select("shingle", "key", "n", F.spark_partition_id().alias("part"))
    return written(arrow_map(ranged, run, "block bigint, key bigint, n int, hub bigint, edge array<bigint>"), "blocks")


def over_edges(found: DataFrame) -> list[tuple[int, int]]:
    """Links of the hubs of a shingle that goes on from range to range."""
    edges = sorted(list(r.edge) for r in found.where("edge is not null").select("edge").collect())  # one row a range
    return [(b[2], a[4]) for a, b in zip(edges, edges[1:], strict=False) if a[3] == b[1] and b[2] != a[4]]


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def narrowed(bits: int, wide: int, to: int) -> int:
    while wide > to:
        wide //= 2
        bits = bits & ((1 << wide) - 1) | bits >> wide
    return bits


class Node:
    __slots__ = ("bits", "children", "few", "large", "members", "small", "whole", "wide")

    def __init__(self, members: range, children: tuple, sizes: list[int], maps: list[tuple[int, int]]):
        self.members, self.children = members, children
        self.small, self.large = sizes[members[0]], sizes[members[-1]]
        under = [(c.bits, c.wide) for c in children] or [maps[i] for i in members]
        self.wide = min(w for _, w in under)
        self.bits = 0
        for b, w in under:
            self.bits |= narrowed(b, w, self.wide)
        self.few = min(c.few for c in children) if children else min(narrowed(*maps[i], self.wide).bit_count() for i in members)
        if children and any(c.wide != self.wide for c in children):
            self.few = min(narrowed(*maps[i], self.wide).bit_count() for i in members)
        self.whole = -1  # a member, once all are known to be connected


def signature_tree(sizes: list[int], maps: list[tuple[int, int]], members: range) -> Node:
    """A binary tree over members that are in order of size."""
    level = [Node(members[i : i + LEAF], (), sizes, maps) for i in range(0, len(members), LEAF)]
    while len(level) > 1:
        level = [Node(range(p[0].members[0], p[-1].members[-1] + 1), tuple(p), sizes, maps) if len(p) > 1 else p[0] for p in (level[i : i + 2] for i in range(0, len(level), 2))]
    return level[0]


def may_link(a_bits: int, a_wide: int, a_few: int, a_small: int, a_large: int, b_bits: int, b_wide: int, b_few: int, b_small: int, b_large: int, exact_width: bool) -> bool:
    """Whether the maximum possible overlap allows a link. A member of a has `few` set bits at least, and at most those that
    both sides have can be of shared shingles; each other bit is a shingle that the other side lacks."""
    if 4 * b_small > 5 * a_large or 4 * a_small > 5 * b_large:
        return False
    most = min(a_large, b_large)
    if a_wide == b_wide:
        both = (a_bits & b_bits).bit_count()
        most = min(most, a_large - a_few + both, b_large - b_few + both)
    elif exact_width:  # two single members: fold the wider map
        to = min(a_wide, b_wide)
        x, y = narrowed(a_bits, a_wide, to), narrowed(b_bits, b_wide, to)
        both = (x & y).bit_count()
        most = min(most, a_large - x.bit_count() + both, b_large - y.bit_count() + both)
    return 9 * most >= 4 * (a_small + b_small)


def connect(sizes: list[int], maps: list[bytes], exact: Callable[[int, int], bool] | None = None, known: list[int | None] = (), own: int | None = None, inner: bool = True) -> Forest:
    """Dual traversal of the members' signature tree (members in order of size): joins all pairs that may link or, if an
    exact test is given, that do. Pairs that are connected already need no test: members of one `known` component, or by links found.

    own: members from here on are guests, in a tree of their own; they are compared with the others but not with each other, and
    the others with each other only if `inner` is set.
    """
    ints = [(int.from_bytes(m, "little"), 8 * len(m)) for m in maps]
    bits = [x.bit_count() for x, _ in ints]
    forest = Forest(len(sizes))
    own = len(sizes) if own is None else own
    root = signature_tree(sizes, ints, range(own)) if own else None
    find = forest.find
    heads: dict[int, int] = {}
    for i, k in enumerate(known):
        if k is not None:
            forest.join(heads.setdefault(k, i), i)

    def whole(x: Node) -> int:
        if x.whole < 0:
            if x.children:
                a, b = (whole(c) for c in x.children)
                if a >= 0 and b >= 0 and find(a) == find(b):
                    x.whole = a
            elif len({find(i) for i in x.members}) == 1:
                x.whole = x.members[0]
        return x.whole

    def pair(i: int, j: int) -> None:
        if find(i) != find(j):
            (x, v), (y, w) = ints[i], ints[j]
            if may_link(x, v, bits[i], sizes[i], sizes[i], y, w, bits[j], sizes[j], sizes[j], True) and (exact is None or exact(i, j)):
                forest.join(i, j)

    todo = [(root, root)] if root and inner else []
    if root and own < len(sizes):
        todo.append((root, signature_tree(sizes, ints, range(own, len(sizes)))))
    while todo:
        a, b = todo.pop()
        wa, wb = whole(a), whole(b)
        if wa >= 0 and wb >= 0 and find(wa) == find(wb):
            continue
        if a is not b and not may_link(a.bits, a.wide, a.few, a.small, a.large, b.bits, b.wide, b.few, b.small, b.large, False):
            continue
        if a is b:
            if a.children:
                x, y = a.children
                todo += [(x, y), (y, y), (x, x)]  # the last comes first: near pairs before far ones
            else:
                for i in a.members:
                    for j in range(i + 1, a.members[-1] + 1):
                        pair(i, j)
        elif a.children and (len(a.members) >= len(b.members) or not b.children):
            todo += [(c, b) for c in a.children]
        elif b.children:
            todo += [(a, c) for c in b.children]
        else:
            for i in a.members:
                for j in b.members:
                    pair(i, j)
    return forest


def forest_edges(keys: list[int], forest: Forest) -> list[tuple[int, int]]:
    """(member, the component's smallest key) of all members that aren't it."""
    least: dict[int, int] = {}
    for i, k in enumerate(keys):
        r = forest.find(i)
        least[r] = min(least.get(r, k), k)
    return [(k, m) for i, k in enumerate(keys) if (m := least[forest.find(i)]) != k]


def candidate_links(members: DataFrame) -> DataFrame:
    """a, b: a forest of the pairs that may link, block by block, of (block, key, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "block"):
            block, keys, sizes, maps = (table.column(c).to_pylist() for c in ("block", "key", "n", "bits"))
            edges, start = set(), 0
            for i in range(1, len(block) + 1):
                if i == len(block) or block[i] != block[start]:
                    if i - start > 1:
                        edges.update(forest_edges(keys[start:i], connect(sizes[start:i], maps[start:i])))
                    start = i
            a, b = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = members.select("block", "key", "n", "bits").repartition("block").sortWithinPartitions("block", "n", "key")
    return arrow_map(together, run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of each node of the edges (a, b), by alternating large and small stars.

    Every round halves paths at least; each is a written table, of which the last remains (discard() takes the result). Only counts
    and checksums come to the driver.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        state = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own, so that both sides of the join are plain shuffles and a hot node's rows are split.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, stars = stars, written(small.unionByName(own.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        discard(last)
        discard(least)
    named = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = named.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out.written_to = stars.written_to
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of wanted (doc_id, text_hash, key, ...) with n, bits and shingles of the document whose set has the key. Null ids
    are met too."""
    extra = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part)
                keep = [i for i, (s, k) in enumerate(zip(sets, part.column("key").to_pylist(), strict=True)) if len(s) and set_key(s) == k]
                own = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in extra], pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([bitmap(sets[i]) for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], [*extra, "n", "bits", "shingles"])

    d, w = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d"), wanted.alias("w")
    held = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))).select("d.text", *[f"w.{c}" for c in extra])
    return arrow_map(held, run, schema + ", n bigint, bits binary, shingles binary")


def true_links(sets: DataFrame) -> DataFrame:
    """a, b, cut: the exact links' forest in each part, of (part, cut, key, known, guest, inner, n, bits, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "part"):
            part, keys, sizes, maps, cut, known, guest, inner = (table.column(c).to_pylist() for c in ("part", "key", "n", "bits", "cut", "known", "guest", "inner"))
            raw = table.column("shingles")
            edges, start = [], 0
            for i in range(1, len(part) + 1):
                if i == len(part) or part[i] != part[start]:
                    once = [j for j in range(start, i) if j == start or keys[j] != keys[j - 1] or guest[j] != guest[j - 1]]
                    if len(once) > 1:
                        sets = [np.frombuffer(raw[j].as_py(), np.uint64) for j in once]

                        def exact(x: int, y: int, sets: list = sets) -> bool:
                            a, b = sorted((sets[x], sets[y]), key=len)
                            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                            return linked(both, len(a), len(b))

                        forest = connect([sizes[j] for j in once], [maps[j] for j in once], exact, [known[j] for j in once], sum(not guest[j] for j in once), inner[start])
                        edges += [(a, b, cut[start]) for a, b in forest_edges([keys[j] for j in once], forest)]
                    start = i
            a, b, c = zip(*edges, strict=True) if edges else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], ["a", "b", "cut"])

    together = sets.select("part", "cut", "key", "known", "guest", "inner", "n", "bits", "shingles").repartition("part").sortWithinPartitions("part", "guest", "n", "key")
    return arrow_map(together, run, "a bigint, b bigint, cut boolean")


def dealt(docs: DataFrame, sets: DataFrame, members: DataFrame, few: bool = False) -> DataFrame:
    """The whole sets of members (node, cut, known, places: parts with whether the member is a guest there and whether the part's own
    members are compared), a row for each part. If members are few, documents are first sieved by a broadcast list of their texts'
    hashes modulo SIEVE."""
    at = ["doc_id", "text_hash", "key", "cut", "known", "places"]
    wanted = members.join(sets.select(F.col("key").alias("node"), "doc_id", "text_hash"), "node").withColumnRenamed("node", "key").select(*at)
    if few:
        sieve = wanted.select(F.pmod("text_hash", F.lit(SIEVE)).alias("s")).distinct()  # SIEVE rows at most
        docs = docs.join(F.broadcast(sieve), F.pmod(F.xxhash64("text"), F.lit(SIEVE)) == F.col("s"), "left_semi")
    return whole_sets(docs, wanted).withColumn("at", F.explode("places")).select("at.*", "key", "cut", "known", "n", "bits", "shingles")


def place(part: F.Column, guest: bool = False, inner: F.Column | None = None) -> F.Column:
    return F.struct(part.alias("part"), F.lit(guest).alias("guest"), (F.lit(True) if inner is None else inner).alias("inner"))


def first_round(groups: DataFrame) -> DataFrame:
    """node, cut, known, places of the members of all groups (node, label): a small group is one part; a large one is dealt in parts
    of PART, with its hubs in each."""
    size = groups.groupBy("label").agg(F.count("*").alias("many"))
    sized = groups.join(size, "label")
    large = F.col("many") > 2 * PART
    hubs = sized.where(large).groupBy("label", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS)).alias("h")).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("hub"))
    parts = F.when(large, F.ceil(F.col("many") / PART).cast("int")).otherwise(F.lit(1))
    marked = sized.join(hubs, "node", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    some = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    return marked.select("node", large.alias("cut"), F.lit(None).cast("bigint").alias("known"), F.transform(some, lambda j: place(F.xxhash64("label", j))).alias("places"))


def second_round(groups: DataFrame, known: DataFrame) -> DataFrame:
    """node, cut, known, places of the members of large groups that have a rest, with the components (node, label) known from the
    first round: each part of REST_PART members meets each REST_PART of the rest."""
    size = groups.groupBy("label").agg(F.count("*").alias("many")).where(F.col("many") > 2 * PART)
    named = groups.join(size, "label").join(known.select("node", F.col("label").alias("known")), "node", "left")
    most = named.where("known is not null").groupBy("label", "known").agg(F.count("*").alias("n")).groupBy("label").agg(F.max(F.struct("n", "known"))["known"].alias("largest"))
    apart = F.coalesce(F.col("known") != F.col("largest"), F.lit(True))
    marked = named.join(most, "label", "left").withColumn("apart", apart)
    rest = marked.where("apart").groupBy("label").agg(F.count("*").alias("rest"))
    both = marked.join(rest, "label").withColumn("parts", F.ceil(F.col("many") / REST_PART).cast("int")).withColumn("chunks", F.ceil(F.col("rest") / REST_PART).cast("int"))
    both = both.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int"))
    at = lambda j, g: F.xxhash64("label", j, g, F.lit(2))
    home = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda g: place(at(F.col("own"), g), False, g == 0))
    away = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own")), lambda j: place(at(j, F.col("chunk")), True, F.col("chunk") == 0))
    return both.select("node", F.lit(True).alias("cut"), "known", F.when(F.col("apart"), F.concat(home, away)).otherwise(home).alias("places"))


def labels(docs: DataFrame, profiled: DataFrame) -> DataFrame:
    """key, label, as a written table: each set that is linked with another one; linked sets have the same label."""
    posted = written(postings(docs, common_shingles(profiled)), "postings")
    found = blocks(posted)
    discard(posted)
    sets = written(profiled.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"), F.first("bits").alias("bits")).select("key", "r.doc_id", "r.text_hash", "bits"), "sets")
    near = candidate_links(found.where("block is not null").select("block", "key", "n").dropDuplicates(["block", "key"]).join(sets.select("key", "bits"), "key"))
    stars = found.where("hub is not null").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    edges = docs.sparkSession.createDataFrame(over_edges(found), "a bigint, b bigint")
    candidates = written(near.unionByName(stars).unionByName(edges), "candidates")
    discard(found)
    named = components(candidates)
    groups = written(named, "groups")
    discard(named)
    discard(candidates)
    links = written(true_links(dealt(docs, sets, first_round(groups))), "links")
    done = links.where("not cut").select(F.col("a").alias("node"), F.col("b").alias("label"))
    done = done.unionByName(done.select(F.col("label").alias("node"), "label").distinct()).distinct()
    used = [sets, groups, links]
    cut = links.where("cut").select("a", "b")
    if not groups.groupBy("label").count().where(F.col("count") > 2 * PART).isEmpty():
        known = components(cut)
        more = written(true_links(dealt(docs, sets, second_round(groups, known), True)), "links")
        large = components(cut.unionByName(more.select("a", "b")))
        done = done.unionByName(large)
        used += [known, more, large]
    out = written(done.select(F.col("node").alias("key"), "label"), "labels")
    for table in used:
        discard(table)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, label of each row of docs, as a written table.

    component_id: the smallest doc_id reachable by links, itself included. A text with one to four words is one shingle;
    null texts and texts without words have none and are linked with nothing (label null). Equal texts are linked even if
    their ids are equal. Null ids are linked like others and are a component's id only if it has no other. Very long texts
    are taken whole. Extra columns are ignored, whatever their names; an empty table gives an empty table.
    """
    profiled = written(profiles(docs), "profiles")
    own = profiled.select("doc_id", "text_hash", "key", "n")
    named = labels(docs, profiled)
    per_key = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    per_key = per_key.join(named, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    least = per_key.groupBy("label").agg(F.min("least").alias("component_id"))
    keyed = per_key.join(least, "label").select("key", "label", "component_id")
    out = own.where("n > 0").join(keyed, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "label")
    none = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("bigint").alias("label"))
    whole = written(out.unionByName(none), "near-copies")
    discard(profiled)
    discard(named)
    return whole


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs less near copies: of each component, the row with the smallest doc_id stays (null ids come last); so
    do rows without words. All columns stay as they were, whatever their names. Of rows that agree in id and text one stays."""
    found = near_copies(docs)
    keep = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash")
    keep = keep.withColumn("_once", F.lit(True))
    free = found.where("label is null").select("doc_id", "text_hash").distinct().withColumn("_once", F.lit(False))
    # The join's keys are columns that the window has too (eqNullSafe has keys of its own), so that whole rows move once.
    at = ["_id", "_none", "text_hash"]
    same = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    rows = docs.select(*same, F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    left = rows.join(keep.unionByName(free).select(*same, "text_hash", "_once"), at)
    place = F.row_number().over(Window.partitionBy(*at).orderBy(F.xxhash64("row")))
    return left.withColumn("_place", place).where("_place = 1 or not _once").select("row.*")
