"""Document fingerprints by a homomorphic multiset hash. DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two, so the order of paragraphs doesn't matter and
paragraphs can be put in or taken out by adding or subtracting their vectors. The vector has three parts:

* four identity lanes modulo 2^32, hashed from the whole paragraph: equal multisets have equal sums;
* LANES lanes modulo 2^21, three packed in a number: each piece of up to four words of the paragraph adds the bits of its
  hash, one to a lane. With n pieces, 2 * lane - n is a sum of random signs (known modulo 2^22, so exact while it is below 2^21
  in size), products of two documents' lanes estimate the product of their piece counts and their cosine is the documents'
  likeness;
* the number of pieces.

Sums are taken in two steps, so that packed lanes never run into each other: plain sums over parts of at most PART units,
in which no lane can reach 2^21, then sums of the parts lane by lane modulo 2^21.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASHES = 2
LANES = 63 * HASHES
PIECE = r"\S+(?:[^\S\n]+\S+){0,3}"
#: Documents are ordered by id in level * level ranges of about RANGE_BYTES of text, but LEVEL levels at least and MOST_LEVELS at most
#: (65,536 ranges: 1.6 GB each at 100 TB). Their edges come from a sample of about EDGE_SAMPLE ids a range; it decides balance, no result.
LEVEL, MOST_LEVELS, RANGE_BYTES, EDGE_SAMPLE = 32, 256, 64_000_000, 64
#: Units whose packed lanes are added up before the lanes are taken apart.
PART = 1 << 20
_LOW32, _LOW21, _ONE_EACH = 0xFFFFFFFF, 0x1FFFFF, 1 << 42 | 1 << 21 | 1
_TOPS = _ONE_EACH << 20


def units(text: Column) -> Column:
    """The paragraphs (kind 0) and the pieces of paragraphs (kind 1) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("s"))
    return F.concat(F.transform(F.split(text, "\n"), unit(0)), F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), unit(1)))


def summed(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys, identity, lanes, pieces: the sums of the vectors of the units (kind, s) of each key. A key's rows that agree in
    `parts` are PART at most."""
    none = F.lit(0).cast("bigint")
    wide = rows.select(
        *keys, *parts, F.col("kind").cast("bigint").alias("kind"),
        *[F.when(F.col("kind") == 0, F.xxhash64("s", F.lit(i))).otherwise(none).alias(f"g{i}") for i in range(2)],
        *[F.when(F.col("kind") == 1, F.xxhash64("s", F.lit(-1 - i))).otherwise(none).alias(f"h{i}") for i in range(HASHES)],
    )
    identity = [f(F.col(f"g{i}")) for i in range(2) for f in (lambda g: g.bitwiseAND(F.lit(_LOW32)), lambda g: F.shiftrightunsigned(g, 32))]
    lanes = [F.shiftrightunsigned(F.col(f"h{i}"), j).bitwiseAND(F.lit(_ONE_EACH)) for i in range(HASHES) for j in range(21)]
    packed = wide.groupBy(*keys, *parts).agg(*[F.sum(c).alias(f"i{k}") for k, c in enumerate(identity)], *[F.sum(c).alias(f"l{k}") for k, c in enumerate(lanes)], F.sum("kind").alias("pieces"))
    vector = F.struct(F.array(*[F.col(f"i{k}").bitwiseAND(F.lit(_LOW32)) for k in range(len(identity))]).alias("identity"), F.array(*[F.col(f"l{k}") for k in range(len(lanes))]).alias("lanes"), "pieces")
    listed = packed.groupBy(*keys).agg(F.collect_list(vector).alias("v"))  # a row of each part: one, but for very long texts
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    whole = F.when(F.size("v") == 1, F.col("v")[0]).otherwise(F.aggregate(rest, F.col("v")[0], _added))
    return listed.select(*keys, whole.alias("v")).select(*keys, "v.identity", "v.lanes", "v.pieces")


def _added(a: Column, x: Column) -> Column:
    return F.struct(identity_plus(a["identity"], x["identity"]).alias("identity"), plus(a["lanes"], x["lanes"]).alias("lanes"), (a["pieces"] + x["pieces"]).alias("pieces"))


def added(vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, identity, lanes, pieces: the sums of any number of fingerprints of each key, lane by lane and without listing them."""
    lane = lambda k, j: F.shiftrightunsigned(F.col("lanes")[k], 21 * j).bitwiseAND(F.lit(_LOW21))
    words = range(21 * HASHES)
    sums = vectors.groupBy(*keys).agg(*[F.sum(F.col("identity")[k]).alias(f"i{k}") for k in range(4)], *[F.sum(lane(k, j)).alias(f"l{k}_{j}") for k in words for j in range(3)], F.sum("pieces").alias("pieces"))
    pack = lambda k: sum((F.shiftleft(F.col(f"l{k}_{j}").bitwiseAND(F.lit(_LOW21)), 21 * j) for j in (1, 2)), F.col(f"l{k}_0").bitwiseAND(F.lit(_LOW21)))
    return sums.select(*keys, F.array(*[F.col(f"i{k}").bitwiseAND(F.lit(_LOW32)) for k in range(4)]).alias("identity"), F.array(*[pack(k) for k in words]).alias("lanes"), "pieces")


def shown(identity: Column, lanes: Column) -> Column:
    """The fingerprint as a string of hexadecimal digits."""
    digits = lambda n: lambda x: F.lpad(F.hex(x), n, "0")
    return F.lower(F.concat(F.array_join(F.transform(identity, digits(8)), ""), F.array_join(F.transform(lanes, digits(16)), "")))


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a multiset with another's paragraphs put in (sign -1: taken out, if they are there), each modulo 2^21. The lanes'
    top bits are added apart, so that nothing is carried from lane to lane."""
    tops, rest = F.lit(_TOPS), F.lit(_TOPS ^ ((1 << 63) - 1))
    if sign > 0:
        return F.zip_with(a, b, lambda x, y: (x.bitwiseAND(rest) + y.bitwiseAND(rest)).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(tops)))
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(tops) - y.bitwiseAND(rest)).bitwiseXOR(x.bitwiseXOR(F.bitwise_not(y)).bitwiseAND(tops)))


def identity_plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(1 << 32)))


def signs(lanes: Column, pieces: Column) -> Column:
    """The LANES sums of random signs."""
    lane = lambda x, k: F.shiftrightunsigned(x, 21 * k).bitwiseAND(F.lit(_LOW21))
    part = lambda k: lambda x: ((F.lit(2) * lane(x, k) - pieces + F.lit(1 << 21)).bitwiseAND(F.lit((1 << 22) - 1)) - F.lit(1 << 21)).cast("double")
    return F.concat(*[F.transform(lanes, part(k)) for k in range(3)])


def likeness(same: Column, a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of two rows of signs, 0 where it is below or a side has none."""
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(same, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, identity, lanes, pieces of each key's paragraphs (rows with the same key add up, as multisets do)."""
    rows = docs.select(F.col(key), F.monotonically_increasing_id().alias("_row"), F.posexplode(units(F.col(text))).alias("_at", "u"))
    return added(summed(rows.select(key, "_row", F.floor(F.col("_at") / PART).alias("_part"), "u.kind", "u.s"), [key, "_row"], ["_part"]), key)


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ranges(docs: DataFrame) -> tuple[Column, Column]:
    """(range of a row by its doc_id, array of the ranges that need the row).

    Ranges are cut at quantiles of doc_id. A range also gets the first id of the next range that has rows (the last range:
    the first id of all), so that every row finds its successor in its own range. The tables here have a row per range.
    """
    rows, size = docs.agg(F.count("*"), F.sum("_bytes")).first()
    level = min(MOST_LEVELS, max(LEVEL, math.isqrt((size or 0) // RANGE_BYTES) + 1))
    many = level * level
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // (EDGE_SAMPLE * many)))) == 0)
    bounds = some.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many)).first()[0] or []
    bounds = sorted(set(bounds))
    coarse, fine = bounds[level - 1 :: level], [bounds[i : i + level] for i in range(0, len(bounds), level)]
    doc_id = F.col("doc_id")
    at = F.size(F.filter(_numbers(coarse), lambda b: b < doc_id)) if coarse else F.lit(0)
    table = F.split(F.lit(";".join(",".join(map(str, f)) for f in fine)), ";")
    own = F.split(F.try_element_at(table, at + 1), ",").cast("array<bigint>")
    got = at * level + (F.coalesce(F.size(F.filter(own, lambda b: b < doc_id)), F.lit(0)) if bounds else F.lit(0))
    got = F.when(doc_id.isNull(), F.lit(0)).otherwise(got).cast("int")
    firsts = {r[0]: r[1] for r in docs.select(got.alias("r"), "doc_id").groupBy("r").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id"))["doc_id"]).collect()}
    order = sorted(firsts)
    return got, [(order[i - 1], firsts[order[i]], i == 0) for i in range(len(order))]


def with_next(docs: DataFrame) -> DataFrame:
    """_range, _rn, _ghost, doc_id, text and next_text of each row in the order of (doc_id, text), nulls first; after the
    last row comes the first. Ghosts are the rows that a range has got from the next one, to be dropped in the end."""
    got, needs = ranges(docs.select("doc_id", F.octet_length("text").alias("_bytes")))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_own", got)
    first_of = F.from_json(F.lit("{" + ",".join(f'"{"-" if f is None else f}":[{b},{int(wrap)}]' for b, f, wrap in needs) + "}"), "map<string,array<int>>")
    extra = F.try_element_at(first_of, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    own = F.struct(F.col("_own").alias("_range"), F.lit(0).alias("_ghost"))
    ghost = F.struct(extra[0].alias("_range"), (extra[1] + 1).alias("_ghost"))
    rows = plain.withColumn("_x", extra).withColumn("_to", F.explode(F.when(F.col("_x").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    rows = rows.select("_to._range", F.col("_to._ghost").alias("_ghost"), "doc_id", "text")
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    return rows.select("*", F.row_number().over(order).alias("_rn"), F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter (by code points, rounded down) replaced by the first as many (or all) of following."""
    cut = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The text moves once, to ranges of doc_id; all that follows (successors, sums, comparisons) stays in the range and is read as
    a sorted stream. Null text is empty text, however long texts are taken whole. Null ids come first. Repeated ids are ordered
    by text, and rows of one id are in one range; a table of one row is its own successor; an empty table gives an empty
    table. Extra columns are ignored, whatever their names.
    """
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(F.col("_ghost") == 0, edited(F.col("text"), F.coalesce("next_text", "text"))))
    side = lambda i, t: F.transform(units(t), lambda u: F.struct(F.lit(i).alias("side"), u["kind"].alias("kind"), u["s"].alias("s")))
    both = F.when(F.col("_ghost") == 0, F.concat(side(0, F.col("text")), side(1, F.col("edited")))).otherwise(side(0, F.col("text")))
    facts = rows.select("_range", "_rn", "_ghost", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), both.alias("both"))
    keys = ["_range", "_rn", "_ghost", "doc_id", "n_chars", "edited_sha256", "side"]
    exploded = facts.select(*keys[:-1], F.posexplode("both").alias("_at", "u")).select(*keys[:-1], "u.side", F.floor(F.col("_at") / PART).alias("_part"), "u.kind", "u.s")
    order = Window.partitionBy("_range").orderBy("_rn", "side")
    found = summed(exploded, keys, ["_part"]).withColumn("own", F.struct("identity", "lanes", signs(F.col("lanes"), F.col("pieces")).alias("signs")))
    seen = found.select(*keys, "own", F.lead("own", 1).over(order).alias("e"), F.lead("own", 2).over(order).alias("n")).where("side = 0 and _ghost = 0")
    same = lambda x: (F.col("own.identity") == F.col(f"{x}.identity")) & (F.col("own.lanes") == F.col(f"{x}.lanes"))
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own.identity"), F.col("own.lanes")).alias("fingerprint"), shown(F.col("e.identity"), F.col("e.lanes")).alias("edited_fingerprint"),
        likeness(same("e"), F.col("own.signs"), F.col("e.signs")).alias("near_edited"), likeness(same("n"), F.col("own.signs"), F.col("n.signs")).alias("near_next"),
    )
