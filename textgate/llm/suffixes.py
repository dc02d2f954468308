"""Passages that documents share, found in a sorted sparse suffix array.

1. Of every window of LEAST successive words one suffix is retained: of the runs of depth(LEAST) words in the window, the one
   of smallest hash (the first of equal ones) says where it begins. Equal windows retain equal suffixes, so about two words in
   LEAST / 2 are kept and no shared window is missed.
2. The retained suffixes are sorted by (key, reach, place). key is the hash of the first depth(LEAST) words, reach that of
   all the words to the left and right that the windows of the suffix cover. Equal beginnings are neighbours in this order as they
   are in the alphabetical one, and neighbours are all that is compared. The array is cut in ranges by Spark; each range is read as
   a stream, and what a range says of the last suffix before it is carried over on the driver (one row a range).
3. A suffix that agrees with its neighbour in key and reach repeats an earlier document in all its windows. Where neighbours agree
   in the key only, matches are extended word by word: one document of each run of equal reaches gives the suffixes at all its
   windows' first words, which are sorted by their LEAST words and compared with their neighbours in the same way.
4. Matches at one distance that overlap are linked: a passage of any length is one match.

Words are compared with A-Z in lower case, by 64-bit hashes, windows by two of them. No step joins or
groups on a passage, so passages that are in very many documents are split over ranges like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import arrow_map, discard, mix, shingles, slices, text_buffer, word_ends, words, written

LEAST = 50
_NO_ID = (1 << 63) - 1
PLACE = ["doc_id", "text_hash", "start"]
SUFFIX = ["key", "sig", *PLACE, "n"]
SUFFIX_SCHEMA = "key bigint, sig bigint, doc_id bigint, text_hash bigint, start int, n int"
_HEAD, _TAIL, _KEY = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def depth(least: int) -> int:
    """Words of a suffix's key: two of them cover a window."""
    return (least + 1) // 2


def window_hashes(runs: np.ndarray, starts: np.ndarray, least: int, head: np.uint64 = _HEAD, tail: np.uint64 = _TAIL) -> np.ndarray:
    """Hashes of the windows that begin at these runs of depth(least) words."""
    return mix(runs[starts] * head + runs[starts + least - depth(least)] * tail)


def kept_suffixes(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, word position in the text, key, signature, words from its first window to it, number of windows) of the kept
    suffixes of texts of words. Texts of fewer than `least` words have none."""
    runs, out = shingles(hashes, bounds, depth(least))
    wide = least - depth(least) + 1
    per_text = np.maximum(np.diff(bounds) - least + 1, 0)
    total = int(per_text.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    starts = np.arange(total) + np.repeat(out[:-1] - (np.cumsum(per_text) - per_text), per_text)
    view = np.lib.stride_tricks.sliding_window_view(runs, wide)
    picked = np.concatenate([starts[i : i + (1 << 16)] + view[starts[i : i + (1 << 16)]].argmin(axis=1) for i in range(0, total, 1 << 16)])
    at, index, n = np.unique(picked, return_index=True, return_counts=True)
    signature = mix(np.add.reduceat(mix(window_hashes(runs, starts, least)), index) + runs[at] * _KEY)
    text = np.searchsorted(out, at, "right") - 1
    return text, at - out[text], runs[at], signature, at - starts[index], n


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def suffix_table(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """key, sig, doc_id, text_hash, start, n: the kept suffixes with the first of their windows and the number of these. Texts
    of fewer than `least` words, empty and null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, hashes, bounds = words(*text_buffer(part.column("text")))
                text, at, key, sig, lead, n = kept_suffixes(hashes, bounds, least)
                rows = pa.array(text)
                cols = [pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array((at - lead).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, SUFFIX)

    return arrow_map(identified(docs), run, SUFFIX_SCHEMA)


def window_table(docs: DataFrame, asked: DataFrame, least: int = LEAST) -> DataFrame:
    """key, sig, doc_id, text_hash, start, n: the suffixes at the first words of all windows of the suffixes asked for (doc_id,
    text_hash, start, n), with two hashes of their `least` words as key and sig, and n = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, hashes, bounds = words(*text_buffer(part.column("text")))
                runs, out = shingles(hashes, bounds, depth(least))
                places = part.column("places")
                start, n = (places.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(2))
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                first = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                rows = pa.array(np.repeat(text, n))
                at = np.repeat(out[text], n) + first
                h, g = window_hashes(runs, at, least), window_hashes(runs, at, least, _TAIL, _KEY)
                cols = [pa.array(g.view(np.int64)), pa.array(h.view(np.int64)), part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(first.astype(np.int32)), pa.array(np.ones(len(h), np.int32))]
                yield pa.RecordBatch.from_arrays(cols, SUFFIX)

    places = asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    held = identified(docs).join(places, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "places")
    return arrow_map(held, run, SUFFIX_SCHEMA)


class Scan:
    """Reads a range of the suffix array and compares neighbours; memory: a batch and one document's equal suffixes.

    A run is what agrees in key and sig, a group what agrees in key. Rows of a run that aren't in its first document are
    matches with it. Rows of its first document (heads) are wanted if the group has another run. What that needs of other ranges
    is marked: lead (in the range's first run), tail (in its last one, which no run of the group precedes).
    """

    NAMES = ("head", "lead", "tail", "varied", *PLACE, "n", *(f"first_{c}" for c in PLACE))

    def __init__(self, heads: bool):
        self.heads, self.run, self.first, self.held, self.followed = heads, None, None, [], False

    def batch(self, rows: list[np.ndarray]) -> list[list[np.ndarray]]:
        """Columns NAMES of what is known after these rows (SUFFIX)."""
        key, sig, place, n = rows[0], rows[1], rows[2:5], rows[5]
        new_run = np.ones(len(key), bool)
        new_run[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        same_key = np.zeros(len(key), bool)
        same_key[1:] = key[1:] == key[:-1]
        before, out = self.run, []
        if before:
            same_key[0] = before["key"] == key[0]
            new_run[0] = not (same_key[0] and before["sig"] == sig[0])
            if new_run[0]:
                out += self.ended(bool(same_key[0]))
        begin = np.flatnonzero(new_run)
        goes_on = not new_run[0]
        if goes_on:
            begin = np.append(0, begin)
        size = np.diff(np.append(begin, len(key)))
        of = np.repeat(np.arange(len(begin)), size)
        first = [c[begin] for c in place]
        preceded, lead = same_key[begin], np.zeros(len(begin), bool)
        lead[0] = before is None or (goes_on and before["lead"])
        if goes_on:
            for c, x in zip(first, before["place"], strict=True):
                c[0] = x
            preceded[0] = before["preceded"]
        if self.first is None:
            self.first = (int(key[0]), int(sig[0]), *(int(c[0]) for c in place))
        followed = np.append(same_key[begin[1:]], False)
        if goes_on and len(begin) > 1:
            out += self.ended(bool(followed[0]))
        elif lead[0] and len(begin) > 1:
            self.followed = bool(followed[0])
        head = (place[0] == first[0][of]) & (place[1] == first[1][of])
        varied = preceded | followed
        last = len(begin) - 1
        keep = ~head | lead[of] | varied[of] if self.heads else ~head | lead[of]
        unknown = head & (of == last) & ~preceded[of]
        columns = lambda at: [head[at], lead[of[at]], np.zeros(len(at), bool), varied[of[at]], *(c[at] for c in place), n[at], *(c[of[at]] for c in first)]
        out.append(columns(np.flatnonzero(keep & ~unknown)))
        if self.heads or lead[last]:
            self.held.append(columns(np.flatnonzero(unknown)))
        self.run = {"key": int(key[-1]), "sig": int(sig[-1]), "place": [int(c[last]) for c in first], "preceded": bool(preceded[last]), "lead": bool(lead[last])}
        return out

    def ended(self, followed: bool) -> list[list[np.ndarray]]:
        """The heads held back, now that their run has ended and its group goes on or not."""
        held, self.held = self.held, []
        if self.run["lead"]:
            self.followed = followed
        if not (followed or self.run["lead"]):
            return []
        return [[*x[:3], x[3] | followed, *x[4:]] for x in held]

    def end(self) -> tuple[list[list[np.ndarray]], list[int]]:
        """(the heads that only later ranges decide, what this range says of its edges)."""
        held = [[x[0], x[1], np.ones(len(x[0]), bool), *x[3:]] for x in self.held]
        r = self.run
        return held, [*self.first, r["key"], r["sig"], *r["place"], int(r["lead"]), int(self.followed), int(r["preceded"])]


def carried(edges: dict[int, list[int]]) -> list[tuple]:
    """(range, first place of its first run, whether another run of the group is before that, after its last run) from the
    edges of all ranges: first key, sig and place, last key, sig and first place, whether there is one run only, whether the group's
    next run follows the first, precedes the last."""
    order = sorted(edges)
    place, before, after = {}, {}, {}
    for i, p in enumerate(order):
        e, q = edges[p], edges[order[i - 1]] if i else None
        place[p], before[p] = e[2:5], False
        if q and q[5] == e[0]:
            if q[6] == e[1]:
                place[p] = place[order[i - 1]] if q[10] else q[7:10]
                before[p] = before[order[i - 1]] if q[10] else bool(q[12])
            else:
                before[p] = True
    for i in range(len(order) - 1, -1, -1):
        e, q = edges[order[i]], edges[order[i + 1]] if i + 1 < len(order) else None
        after[order[i]] = bool(q and q[0] == e[5] and (q[1] != e[6] or (after[order[i + 1]] if q[10] else q[11])))
    return [(p, *place[p], before[p], after[p]) for p in order]


def neighbours(table: DataFrame, heads: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, heads, written table) of a suffix array (SUFFIX). Matches: place, n and the run's first place; heads: place and n
    of the suffixes of each run's first document where the group has several runs, if they are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, part = Scan(heads), 0
        kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int64(), pa.int64(), pa.int32()], pa.int32(), *[pa.int64(), pa.int64(), pa.int32()], pa.list_(pa.int64())]
        names = ["part", *Scan.NAMES, "edge"]

        def shown(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for x in found:
                if len(x[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), part), pa.int32()), *[pa.array(c, k) for c, k in zip(x, kinds[1:-1], strict=True)], pa.nulls(len(x[0]), kinds[-1])], names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                yield from shown(scan.batch([batch.column(c).to_numpy() for c in SUFFIX]))
        if scan.first:
            held, edge = scan.end()
            yield from shown(held)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.nulls(1, k) for k in kinds[1:-1]], pa.array([edge], kinds[-1])], names)

    order = ["key", "sig", *PLACE]
    ranged = table.select(*SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    place = "doc_id bigint, text_hash bigint, start int"
    first = ", ".join(f"first_{x}" for x in place.split(", "))
    out = written(arrow_map(ranged, run, f"part int, head boolean, lead boolean, tail boolean, varied boolean, {place}, n int, {first}, edge array<bigint>"), "suffix-array")
    spark = table.sparkSession
    edges = {r.part: list(r.edge) for r in out.where("edge is not null").select("part", "edge").collect()}  # one row a range
    over = spark.createDataFrame(carried(edges), "part int, c_doc_id bigint, c_text_hash bigint, c_start int, before boolean, after boolean")
    rows = out.where("edge is null").join(F.broadcast(over), "part")
    lead, head = F.col("lead"), F.col("head")
    new = lead & ((F.col("c_doc_id") != F.col("doc_id")) | (F.col("c_text_hash") != F.col("text_hash")))
    matches = rows.where(~head | new).select(*PLACE, "n", *[F.when(lead, F.col(f"c_{c}")).otherwise(F.col(f"first_{c}")).alias(f"first_{c}") for c in PLACE])
    wanted = rows.where(head & ~new & (F.col("varied") | (lead & F.col("before")) | (F.col("tail") & F.col("after")))).select(*PLACE, "n")
    return matches, wanted, out


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, start_word, n_words, first_doc_id, first_hash, first_word, as a written table: passages of `least` words or
    more of a document that an earlier one has.

    A document is a doc_id and a text; documents are ordered by doc_id (null ids last), then by the text's hash. Positions count the
    words of the text. A passage that repeats parts of several documents has a row for each; rows may overlap. Passages
    that repeat inside one document only don't count: in verse, tables or code that is no copy of anything. Equal rows
    are one document. Empty tables, null texts and texts of fewer than `least` words give nothing. Very long texts are
    suffixes like any others; extra columns are ignored.
    """
    table = written(suffix_table(docs, least), "suffixes")
    alike, heads, array = neighbours(table, True)
    windows = written(window_table(docs, heads, least), "windows")
    discard(table)
    single, _, small = neighbours(windows, False)
    discard(windows)
    matches = alike.unionByName(single).withColumn("stop", F.col("start") + F.col("n") + (least - 1)).withColumn("_by", F.col("start") - F.col("first_start"))
    same = ["doc_id", "text_hash", "first_doc_id", "first_text_hash", "_by"]
    order = Window.partitionBy(*same).orderBy("start", "stop")
    far = F.col("start") + (least - 1) > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = matches.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*same, "_run").agg(F.min("start").alias("start_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.min("first_start").alias("first_word"))
    out = written(runs.select("doc_id", "text_hash", "start_word", "n_words", "first_doc_id", F.col("first_text_hash").alias("first_hash"), "first_word"), "passages")
    discard(array)
    discard(small)
    return out


def spans_of(found: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, first_word for reports; null ids are null again."""
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return found.select(real("doc_id"), "start_word", "n_words", real("first_doc_id"), "first_word")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in the spans (first word, number) and the white space after each."""
    raw = text.encode()
    buffer = np.frombuffer(raw, np.uint8)
    starts, _, bounds = words(buffer, np.array([0, len(raw)]))
    ends = word_ends(buffer, np.array([0, len(raw)]), starts)
    gone = np.zeros(len(raw) + 1, np.int64)
    for first, n in spans:
        last = min(first + n, len(starts))
        gone[starts[first]] += 1
        gone[starts[last] if last < len(starts) else len(raw) if first == 0 else ends[last - 1]] -= 1
    return buffer[np.cumsum(gone[:-1]) == 0].tobytes().decode()


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs less repeated passages: each passage stays in the first document that has it (see repeats()). Documents of which
    no word is left go; all others stay, texts without repeats as they were. n_chars follows the text, all other columns stay,
    whatever their names. Equal rows are treated alike."""
    spans = repeats(docs, least).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    keyed = docs.select(rest.alias("rest"), "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash")).alias("d")
    s = spans.alias("s")
    joined = keyed.join(s, (F.col("d._id") == F.col("s.doc_id")) & (F.col("d._hash") == F.col("s.text_hash")), "left").select("d.rest", "d.text", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, keep = part.column("text").to_pylist(), []
                spans = part.column("spans").to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        text[i] = cut(text[i], [(x["start_word"], x["n_words"]) for x in s])
                    if not s or text[i].strip(" \t\n\x0b\x0c\r"):
                        keep.append(i)
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("rest").take(rows), pa.array(text, pa.string()).take(rows), pa.array([bool(s) for s in spans], pa.bool_()).take(rows), pa.array([len(t or "") for t in text], pa.int64()).take(rows)], ["rest", "text", "cut", "size"])

    kind = StructType([StructField("rest", joined.schema["rest"].dataType), StructField("text", StringType()), StructField("cut", BooleanType()), StructField("size", LongType())])
    left = arrow_map(joined, run, kind)
    own = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.col("size")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
