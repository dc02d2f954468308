"""Small tables with nulls, empty and very long texts, ties, repeated rows, clashing columns; brute force beside operators."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("textgate.llm")
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textgate.llm import bpe, common, fingerprint, langid, media, mixing, ngram_join, packing, quality, sharding, suffixes

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = np.random.default_rng(5)
VOCAB = ["ab" + "".join(rng.choice(list("cdefg"), 4)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCAB, n))


PASSAGE = prose(60, 99)
LONG = prose(20_000, 7)
BASE = prose(120, 1)
TEXTS = [
    BASE, BASE, BASE.replace(BASE.split()[60], "other", 1), prose(100, 2) + " " + PASSAGE + " " + prose(50, 3), PASSAGE + "\n" + prose(80, 4), None, "", "  \n ", "one two", "One  TWO", "a b c d e", LONG, "héé 漢字 <|endoftext|> x\x00y \t\r\n  z",
]
ROWS = [(i, t, "en" if i % 2 else "de", None if i == 3 else "s" + str(i % 3), len(t or "")) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = "key int, ids string, slot int, n int, size int"
    rows = [(*r, 1, "x", 2, 3, 4) for r in [*ROWS, ROWS[0]]]  # a repeated row, and columns that clash with inner names
    return spark.createDataFrame(rows, SCHEMA + ", " + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]


def test_bpe(docs, empty):
    own = Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = own.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    d = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    assert d[0].decoded_sha256 == hashlib.sha256(BASE.encode()).hexdigest()
    assert bpe.encode(empty, PATH).isEmpty()


def test_bpe_random_strings():
    own, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    r = np.random.default_rng(3)
    letters = list("ab  \n\t\r'sd1٣ é漢😀.,!?ing　\x1c\x00") + ["the", "<|endoftext|>", "'re"]
    texts = ["".join(r.choice(letters, r.integers(0, 30))) for _ in range(3000)] + ["a" * 5000, " " * 300]
    for t, b, e in zip(texts, codec.encode_all(texts), own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == e.ids
        assert codec.decode(b) == own.decode(e.ids, skip_special_tokens=False)


def test_packing(docs, empty):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    packed = packing.pack(docs, ranks, 256).collect()
    own, parts = packing.encoding(ranks), {}
    for r in packed:
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
        for d, k, a, b in zip(r.doc_ids, r.part_of, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts.setdefault((d, k), []).append(ids[a:b])
            assert places[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(TEXTS):
        whole = [x for k in sorted(p[1] for p in parts if p[0] == i) for x in parts[i, k][0].tolist()]
        assert whole == own.encode_ordinary(t or "")
    assert len(parts[0, 0]) == 2  # the repeated row
    assert packing.pack(empty, ranks).isEmpty()


def test_packed_rows_do_not_depend_on_partitions(docs, tmp_path, monkeypatch):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    key = lambda rows: sorted((r.doc_ids, r.part_of, bytes(r.input_ids), bytes(r.position_ids)) for r in rows)
    want = key(packing.pack(docs, ranks, 256).collect())
    packing.write_packed(docs.repartition(3), ranks, str(tmp_path / "packed"), 256)
    back = docs.sparkSession.read.parquet(str(tmp_path / "packed"))
    assert key(back.collect()) == want and back.columns == [x.split()[0] for x in packing.PACKED_SCHEMA.split(", ")]
    assert all(np.frombuffer(r.input_ids, "<u4").shape == (256,) for r in back.collect())


def test_best_fit_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(50):
        lengths = r.integers(0, 40, 60).tolist()
        room, rows = [], []
        for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
            fits = [k for k, x in enumerate(room) if x >= lengths[i]]
            if fits:
                k = min(fits, key=lambda k: room[k])
            else:
                k = len(room)
                room.append(40)
                rows.append([])
            room[k] -= lengths[i]
            rows[k].append(i)
        got = packing.best_fit_decreasing(lengths, 40)
        assert sorted(i for x in got for i in x) == sorted(i for x in rows for i in x) and len(got) == len(rows)


def test_language(docs, empty):
    en, de = "the and of that with thing ", "der und ein mit schö über "
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice((en if i % 2 else de).split(), 60)) for i in range(400)]
    net = langid.train(texts[:300], ["en" if i % 2 else "de" for i in range(300)])
    spark = docs.sparkSession
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts[300:])], "doc_id bigint, text string")
    assert all(x.lang_pred == ("en" if x.doc_id % 2 else "de") for x in langid.identify(held, net).collect())
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (5, 6, 7))
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.identify(docs, net).count() == len(TEXTS) + 1
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").isEmpty()
    assert langid.identify(empty, net).isEmpty()
    assert {r[0] for r in docs.where(langid.held_out()).select("doc_id").collect()} == {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_quality(docs, empty):
    good, bad = [prose(60, i) for i in range(200)], [prose(30, i) + " | | !! " + "zz " * 20 for i in range(100)]
    toxic = [prose(50, i) + " nasty vile nasty" for i in range(100)]
    model = quality.train(good[:150] + bad[:70] + toxic[:70], [2] * 150 + [1] * 70 + [0] * 70)
    assert (np.diff(model.thresholds) > 0).all()
    spark = docs.sparkSession
    held = spark.createDataFrame(list(enumerate(good[150:] + bad[70:] + toxic[70:])), "doc_id bigint, text string")
    rows = quality.score(held, model).orderBy("doc_id").collect()
    assert np.mean([r.selected == (i < 50) for i, r in enumerate(rows)]) > 0.85
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert not got[5].selected and not got[6].selected and got[5].expected_grade == 0.0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == len(TEXTS) + 1
    assert quality.score(empty, model).isEmpty()


def test_quality_gradient_against_differences():
    """The gradient of the cumulative-link likelihood, by scores and thresholds, against finite differences; sparse() against a sum per text."""
    r = np.random.default_rng(9)
    s, y, t = r.normal(size=12), r.integers(0, 4, 12), np.array([-1.0, 0.2, 1.1])

    def loss(s, t):
        edge = [-np.inf, *t, np.inf]
        cdf = lambda z: 1 / (1 + np.exp(-z))
        return -np.mean([np.log(cdf(edge[k + 1] - x) - cdf(edge[k] - x)) for x, k in zip(s, y, strict=True)])

    by_score, by_threshold = quality.gradient(s, y, t)
    step = 1e-6
    for got, x, f in ((by_score, s, lambda v: loss(v, t)), (by_threshold, t, lambda v: loss(s, v))):
        for i in range(len(x)):
            d = np.eye(len(x))[i] * step
            assert abs((f(x + d) - f(x - d)) / (2 * step) - got[i]) < 1e-6
    texts = [prose(30, i) + " zz zz" for i in range(130)] + ["", "a"]
    at, value, bounds = quality.sparse(texts)
    model = quality.OrdinalModel(r.normal(size=quality.N_WEIGHTS).astype(np.float32), t)
    column = quality.pa.array(texts, quality.pa.string())
    want = model.scores(*quality.text_buffer(column))
    assert np.allclose([(model.weights[at[a:b]] * value[a:b]).sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], want, atol=1e-3)


def test_fingerprint(docs, empty):
    got = fingerprint.with_edits(docs).collect()
    order = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(0, BASE)])
    want = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        want.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest())
    assert len(got) == len(order)
    for r in got:
        assert r.edited_sha256 in want[r.doc_id] and r.n_chars == len(TEXTS[r.doc_id] or "")
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint and by[5].fingerprint == by[6].fingerprint
    assert by[11].near_edited > 0.6 > by[3].near_next
    assert fingerprint.with_edits(empty).isEmpty()


def test_fingerprint_is_homomorphic(spark):
    rows = [("a", "one two\nthree four five six seven"), ("b", "three four five six seven\none two"), ("p", "one two"), ("q", "three four five six seven")]
    f = {r.k: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert (f["a"].identity, f["a"].lanes) == (f["b"].identity, f["b"].lanes)
    assert [(x + y) % (1 << 32) for x, y in zip(f["p"].identity, f["q"].identity, strict=True)] == f["a"].identity
    sums = spark.createDataFrame([(f["p"].lanes, f["q"].lanes, f["a"].lanes)], "p array<bigint>, q array<bigint>, a array<bigint>")
    got = sums.select(fingerprint.plus(F.col("p"), F.col("q")), fingerprint.plus(F.col("a"), F.col("q"), -1)).first()
    assert list(got) == [f["a"].lanes, f["p"].lanes]


def brute_fingerprint(spark, texts):
    """(identity, single lanes modulo 2^21, pieces) of each text by plain sums; only the hash function is Spark's."""
    sets = [[(0, p) for p in t.split("\n")] + [(1, " ".join(m)) for m in re.findall(r"\S+(?:[^\S\n]+\S+){0,3}", t) for m in [[m]]] for t in texts]
    names = sorted({x for s in sets for x in s})
    salts = [0, 1, -1, -2]
    hashed = spark.createDataFrame(names, "kind int, s string").select("kind", "s", *[F.xxhash64("s", F.lit(i)).alias(f"h{k}") for k, i in enumerate(salts)]).collect()
    h = {(r.kind, r.s): [x % (1 << 64) for x in (r.h0, r.h1, r.h2, r.h3)] for r in hashed}
    out = []
    for s in sets:
        own = [h[x][:2] for x in s if x[0] == 0]
        identity = [sum((g[i] >> 32 * half) & 0xFFFFFFFF for g in own) % (1 << 32) for i in range(2) for half in range(2)]
        pieces = [h[x][2:] for x in s if x[0] == 1]
        lanes = [[sum((g[i] >> (j + 21 * k)) & 1 for g in pieces) % (1 << 21) for k in range(3)] for i in range(2) for j in range(21)]
        out.append((identity, lanes, len(pieces)))
    return out


def test_fingerprint_against_brute_force(spark, monkeypatch):
    texts = [TEXTS[3] + "\n" + TEXTS[2], TEXTS[10], "", "a\n\nb c d e f\ta", PASSAGE]
    want = brute_fingerprint(spark, texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for part in (1 << 20, 7):
        monkeypatch.setattr(fingerprint, "PART", part)
        got = sorted(fingerprint.fingerprints(d).collect(), key=lambda r: r.doc_id)
        for r, (identity, lanes, pieces) in zip(got, want, strict=True):
            assert r.identity == identity and r.pieces == pieces
            assert [[(x >> 21 * k) & 0x1FFFFF for k in range(3)] for x in r.lanes] == lanes
        rows = sorted(fingerprint.with_edits(d).collect(), key=lambda r: r.doc_id)
        sums = [np.array([2 * x - n for w in lanes for x in w], float) for _, lanes, n in want]
        for i, r in enumerate(rows):
            a, b = sums[i], sums[(i + 1) % len(rows)]
            norm = np.sqrt((a @ a) * (b @ b))
            assert abs(r.near_next - (max(0.0, a @ b / norm) if norm else 0.0)) < 1e-9
            assert r.fingerprint == "".join(f"{x:08x}" for x in want[i][0]) + "".join(f"{sum(v << 21 * k for k, v in enumerate(w)):016x}" for w in want[i][1])


def test_fingerprint_of_millions_of_pieces(spark, monkeypatch):
    """Lanes are reduced, not carried into each other: 6 million pieces under one key, and a text in parts of 1000 units."""
    r = np.random.default_rng(17)
    single = r.integers(0, 1 << 20, (60, 126))
    pack = lambda v: [int(v[3 * k] + (v[3 * k + 1] << 21) + (v[3 * k + 2] << 42)) for k in range(42)]
    rows = [("a", [int(x) for x in r.integers(0, 1 << 32, 4)], pack(v.tolist()), 100_000) for v in single]
    got = fingerprint.added(spark.createDataFrame(rows, "k string, identity array<bigint>, lanes array<bigint>, pieces bigint"), "k").first()
    assert got.pieces == 6_000_000 and got.lanes == pack((single.sum(axis=0) % (1 << 21)).tolist())
    assert got.identity == [sum(x[1][i] for x in rows) % (1 << 32) for i in range(4)]
    text = spark.createDataFrame([("a", "w0\n" * 20_000 + "w1")], "k string, text string")
    whole = fingerprint.fingerprints(text, "k").first()
    monkeypatch.setattr(fingerprint, "PART", 1000)
    assert fingerprint.fingerprints(text, "k").first() == whole and whole.pieces == 20_001


def test_fingerprint_with_null_and_repeated_ids(spark):
    rows = [(None, "x y"), (None, None), (5, "b\nc"), (5, "a"), (5, "a")]
    got = fingerprint.with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (5, 1), (5, 1), (5, 3)]
    assert sorted(r.near_next for r in got if r.doc_id == 5 and r.n_chars == 1)[1] == 1.0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def test_near_copies(docs, empty, spark, monkeypatch):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()}
    assert got == brute_components([(i, t) for i, t in enumerate(TEXTS)])
    assert ngram_join.near_copies(empty).isEmpty()
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert kept == [0, 3, 4, 5, 6, 7, 8, 10, 11, 12]
    r = np.random.default_rng(8)
    rows = []
    for g in range(6):  # chains of copies with ever more changes, all with a common passage
        w = prose(60, 100 + g).split()
        for _ in range(12):
            w[int(r.integers(0, 60))] = str(r.choice(VOCAB))
            rows.append((len(rows), PASSAGE[:200] + " " + " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block, part, hubs, rest in ((512, 256, 16, 2048), (2, 3, 1, 2)):  # cut blocks and groups as if they were large
        for name, value in (("BLOCK", block), ("PART", part), ("HUBS", hubs), ("REST_PART", rest)):
            monkeypatch.setattr(ngram_join, name, value)
        assert {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.near_copies(d).collect()} == brute_components(rows)


def test_phrases_of_few_documents_make_no_blocks(spark):
    """Phrases that 6 of 400 documents each have are ordered last: otherwise, at millions of documents, each would be a star
    of thousands of candidates, and all of these one group."""
    r = np.random.default_rng(41)
    phrases = [" ".join(f"p{i}w{j}" for j in range(8)) for i in range(60)]
    held = [p for p in phrases for _ in range(6)]
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(30)] + [held[i % 360]] + [f"d{i}y{j}" for j in range(30)])) for i in r.permutation(400).tolist()]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = ngram_join.postings(d, ngram_join.common_shingles(ngram_join.profiles(d)))
    assert found.count() == sum(ngram_join.prefix(len(t.split()) - 4) for _, t in rows)
    assert found.groupBy("shingle").agg(F.count_distinct("key").alias("n")).where("n > 1").isEmpty()


def test_order_of_shingles_is_the_same_for_all_sets():
    r = np.random.default_rng(42)
    last = np.unique(r.integers(0, 300, 80).astype(np.uint64))
    place = r.permutation(len(last)).astype(np.int32)
    rank = {int(s): (1, int(i)) for s, i in zip(last, place, strict=True)}
    for n in (1, 5, 60, 250):
        tokens = np.unique(r.integers(0, 300, n).astype(np.uint64))
        for p in (1, 3, len(tokens)):
            want = sorted(tokens.tolist(), key=lambda s: rank.get(s, (0, s)))[:p]
            assert sorted(ngram_join.first_of(tokens, p, last, place).tolist()) == sorted(want)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    assert ngram_join.first_of(tokens, 3, *none).tolist() == tokens[:3].tolist()
    shingle, count = ngram_join.often(np.arange(9, dtype=np.uint64), np.array([1, 2, 5, 1, 4, 2, 3, 1, 2]), 3)
    assert sorted(zip(shingle.tolist(), count.tolist(), strict=True)) == [(2, 5), (4, 4), (6, 3)]


def test_common_shingles_are_the_most_frequent(spark):
    rows = spark.createDataFrame([([(7, 4), (-3, 2)],), ([(7, 5), (9, 3), (11, 2)],)], "common array<struct<shingle: bigint, n: bigint>>")
    for most, want in ((10, [7, 9, -3, 11]), (3, [7, 9]), (1, [7]), (0, [])):  # equal counts are in or out together
        last, place = ngram_join.common_shingles(rows, most)
        assert last.tolist() == sorted(last.tolist()) and set(last.view(np.int64).tolist()) == set(want)
        at = dict(zip(last.view(np.int64).tolist(), place.tolist(), strict=True))
        assert sorted(at.values()) == list(range(len(want))) and (not want or at[7] == len(want) - 1)


def test_blocks_do_not_depend_on_ranges():
    """However postings are cut in ranges and batches, sets that share a shingle are connected by blocks and stars."""
    r = np.random.default_rng(21)
    rows = np.array(sorted((int(r.integers(0, 9)) ** 2 // 8, int(r.integers(5, 9)), int(r.integers(0, 60))) for _ in range(150)))

    def joined(cuts, steps):
        up = {int(k): int(k) for k in rows[:, 2]}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        edges = []
        for p, own in enumerate(np.split(rows, cuts)):
            reader, stars = ngram_join.BlockReader(), []
            for b in range(0, len(own), steps):
                x = own[b : b + steps]
                blocks, more = reader.add(x[:, 0], x[:, 2], x[:, 1])
                stars += more + [(k, int(k[0])) for _, k, _ in blocks]
            if len(own):
                more, edge = reader.end()
                stars += more
                edges.append([p, *edge])
            for keys, hub in stars:
                for k in keys.tolist():
                    up[find(k)] = find(hub)
        for a, b in zip(edges, edges[1:], strict=False):
            if a[3] == b[1]:
                up[find(a[4])] = find(b[2])
        return {frozenset(k for k in up if find(k) == x) for x in map(find, up)}

    want = joined([], 1000)
    for _ in range(60):
        assert joined(sorted(r.integers(0, 151, int(r.integers(0, 20))).tolist()), int(r.integers(1, 30))) == want


def test_large_group_costs_its_number(spark, monkeypatch):
    """A group of 2,000 near copies: parts hold a copy of each set and of the hubs, not pairs of parts."""
    r = np.random.default_rng(31)
    base = prose(150, 41).split()
    rows = []
    for i in range(2000):
        w = list(base)
        for at in r.integers(0, 150, int(r.integers(0, 4))):
            w[int(at)] = str(r.choice(VOCAB))
        rows.append((i, " ".join(w)))
    seen = []
    whole = ngram_join.true_links
    monkeypatch.setattr(ngram_join, "true_links", lambda sets: (seen.append(sets.count()), whole(sets))[1])
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.near_copies(d).collect()
    assert len(got) == 2000 and {x.component_id for x in got} == {0}
    assert seen and sum(seen) < 2 * 2000


def test_repeats(docs, empty):
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.first_word) for r in suffixes.repeats(docs).collect()}
    assert (4, 0, 60, 3, 100) in got and (1, 0, 120, 0, 0) in got
    assert all(d in (1, 2, 4) for d, *_ in got)
    left = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert left[3].text == TEXTS[3] and left[4].text == prose(80, 4) and left[4].n_chars == len(left[4].text)
    assert 1 not in left and left[11].text == LONG and left[9].text == "One  TWO"
    assert suffixes.repeats(empty).isEmpty()


def test_written_tables_leave_no_shuffle_files(spark):
    """Spark deletes shuffle files at the driver's garbage collections, which needn't come before the disk is full."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    def left(before, wait):
        until = time.time() + wait
        while (now := files() - before) and time.time() < until:
            time.sleep(0.1)
        return now

    a = spark.range(10_000).selectExpr("id", "id % 10 g")
    both = a.join(a.groupBy("g").count(), "g").distinct()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    said, before = spark.conf.get(setting, None), files()
    whole = common.written(both, "both")
    assert not left(before, 10)
    assert spark.conf.get(setting, None) == said and whole.count() == 10_000 == len(whole.distinct().collect())
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        common.written(a.select(F.expr("raise_error('DIVIDE_BY_ZERO')")), "failed")
    assert spark.conf.get(setting, None) == said


def test_rows_of_each_group_move_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "near_copies", lambda d: d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("label")))
    rows = [(1, BASE, "b"), (1, BASE, "a"), (1, BASE, "a"), (None, BASE, "c"), (0, BASE, "d"), (2, None, "e"), (3, "x", "f"), (3, "y", "g")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, _id string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in got.collect()) == sorted((d is None, d, t or "") for d, t in {r[:2] for r in rows if r[0] != 3} | {(3, "x")})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("Join")]
    assert "Window" in above and "Exchange" not in above  # the join's own exchange of rows serves the window


def test_near_copies_with_null_ids(spark):
    """A set that only rows without id hold is linked, and is a bridge between sets that aren't linked with each other."""
    w = prose(200, 8000).split()
    change = lambda x, n, at: " ".join(v if not at <= i < at + n else f"new{i}" for i, v in enumerate(x))
    bridge = change(w, 8, 90)
    far = change(bridge.split(), 8, 150)
    rows = [(1, " ".join(w)), (None, bridge), (3, far), (None, prose(50, 8001)), (None, None), (6, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_copies(d).collect()}
    assert got[3, 196] == got[None, 196] == got[1, 196] == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(d).collect()) == sorted([(1, rows[0][1]), (0, rows[3][1]), (0, ""), (6, "")])


def brute_repeats(texts, least=50):
    """Document -> its words that are in a window of an earlier document."""
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - least + 1):
            f = first.setdefault(tuple(w[j : j + least]), i)
            if f != i:
                want.setdefault(i, set()).update(range(j, j + least))
    return want


def check_repeats(spark, texts):
    """repeats() finds what brute force finds, word by word, and each row is a true match."""
    got, w = {}, [words(t) for t in texts]
    for x in suffixes.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)).collect():
        a, b = w[x.doc_id], w[x.first_doc_id]
        assert x.first_doc_id < x.doc_id and x.n_words >= 50 and a[x.start_word : x.start_word + x.n_words] == b[x.first_word : x.first_word + x.n_words]
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.start_word + x.n_words))
    assert got == brute_repeats(texts)
    return got


def test_repeats_against_brute_force(spark):
    r = np.random.default_rng(4)
    passages = [prose(int(r.integers(30, 90)), 200 + i) for i in range(8)]
    check_repeats(spark, [" ".join([prose(int(r.integers(5, 60)), 300 + i), passages[int(r.integers(0, 8))], prose(int(r.integers(5, 60)), 600 + i)]) for i in range(60)])


def test_repeats_in_whichever_document(spark):
    """Passages that share a common line, and texts that share different parts with different documents: no word is lost."""
    texts = []
    for k, (line, both) in enumerate([(49, 55), (45, 61), (40, 80), (30, 52), (48, 51)] * 8):
        middle, sides = prose(line, 5000 + k), [prose(both - line, 5100 + k).split()[i::2] for i in range(2)]
        shared = " ".join([*sides[0], middle, *sides[1]])
        texts += [f"{prose(20, 6000 + k)} {middle} {prose(20, 7000 + k)}", f"{prose(30, 8000 + k)} {shared} {prose(30, 9000 + k)}", f"{prose(25, 10000 + k)} {shared} {prose(25, 11000 + k)}"]
    long = prose(150, 77).split()
    texts += [" ".join(long[:80]) + " " + prose(40, 78), prose(40, 79) + " " + " ".join(long[40:]), " ".join(long)]
    assert len(check_repeats(spark, texts)) > 40


def test_repeats_of_hot_passages_over_many_ranges(spark):
    """Copies of few texts and runs of one word, in more ranges than there are different suffixes: runs go over range edges."""
    r = np.random.default_rng(12)
    pool = [prose(60, 70 + i) for i in range(3)] + ["la " * 200, "la " * 130 + prose(55, 80)]
    texts = [" ".join(pool[int(i)] for i in r.integers(0, 5, int(r.integers(1, 4)))) for _ in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, conf in ((97, "false"), (3, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
            check_repeats(spark, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_edges_do_not_matter():
    """However the sorted array is cut in ranges and batches, matches and heads are the same."""
    r = np.random.default_rng(6)
    rows = np.array(sorted((int(r.integers(0, 6)), int(r.integers(0, 3)), int(r.integers(0, 5)), 0, i) for i in range(120)))

    def found(cuts, steps):
        out, edges = [], {}
        for p, own in enumerate(np.split(rows, cuts)):
            scan = suffixes.Scan(True)
            parts = [x for b in range(0, len(own), steps) for x in scan.batch([*own[b : b + steps].T, np.ones(len(own[b : b + steps]), int)])]
            if len(own):
                held, edges[p] = scan.end()
                out += [(p, *(c.item() for c in row)) for x in parts + held for row in zip(*x, strict=True)]
        over = {p: x for p, *x in suffixes.carried(edges)}
        matches, heads = [], []
        for p, head, lead, tail, varied, doc, text, start, _, fdoc, ftext, fstart in out:
            cdoc, ctext, cstart, before, after = over[p]
            if lead:
                fdoc, ftext, fstart = cdoc, ctext, cstart
            if not head or (doc, text) != (fdoc, ftext):
                matches.append((doc, start, fdoc, fstart))
            elif varied or (lead and before) or (tail and after):
                heads.append((doc, start))
        return sorted(matches), sorted(heads)

    want = found([], 1000)
    assert want[0] and want[1]
    for _ in range(60):
        cuts = sorted(r.integers(0, 121, int(r.integers(0, 40))).tolist())
        assert found(cuts, int(r.integers(1, 20))) == want


def test_cut_keeps_other_columns(spark):
    rows = [(i, t, f"x{i}", None) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_chars int")
    left = {r.doc_id: r for r in suffixes.without_repeats(d).collect()}
    assert left[4].text == prose(80, 4) and left[4].spans == "x4" and left[4].n_chars == len(left[4].text) and left[3].n_chars is None
    assert suffixes.without_repeats(d).columns == d.columns


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3, 64).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
    for k in {r.shard for r in rows}:
        places = sorted(r.slot for r in rows if r.shard == k)
        assert places == list(range(len(places)))
    load = {k: sum(r.size for r in rows if r.shard == k) for k in range(3)}
    slots = {s: sum(r.size for r in rows if r.virtual_slot == s) for s in {r.virtual_slot for r in rows}}
    fullest, least = max(load, key=load.get), min(load.values())
    assert {r.map_version for r in rows} == {2}  # near equal: no slot of the fullest shard could be moved with gain
    assert all(slots[r.virtual_slot] >= load[fullest] - least for r in rows if r.shard == fullest)
    assert sharding.shard(empty).isEmpty()


def test_shards_of_many_rows_are_near_equal(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(xxhash64(id), 900) as int))").alias("text"))
    load = [r[1] for r in sharding.shard(rows).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(load) == 24 and max(load) - min(load) < 0.01 * max(load)


def test_slot_map_edits():
    sizes = {s: int(x) for s, x in enumerate(rng.integers(1, 100, 512))}
    a = sharding.SlotMap.build(sizes, 8, 512)
    load = lambda m: [sum(sizes[s] for s in range(512) if m.shard_of[s] == k) for k in range(m.n_shards)]
    assert max(load(a)) - min(load(a)) <= 100
    b = a.rebalance(sizes, 9)
    assert b.version == 2 and max(load(b)) - min(load(b)) <= 100
    assert all(a.shard_of[s] == b.shard_of[s] for s in range(512) if s not in b.moved) and len(set(b.moved)) < 512 / 6
    assert set(b.rebalance(sizes, 7).shard_of) == set(range(7))


def test_media(docs, empty):
    got = {r.doc_id: r for r in media.document_media(docs).collect()}
    assert media.document_media(docs).count() == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.store(full)).hexdigest() and media.load(media.store(full)) == full
    assert got[0].feature == got[1].feature and got[0].caption == f"{len(BASE)} bytes of text"
    assert (got[0].position, got[0].n_parts) == (1, 2) and (got[5].position, got[5].n_parts) == (0, 1) and (got[4].position, got[4].n_parts) == (1, 3)
    x = np.frombuffer((TEXTS[8] + " " * 185).encode(), np.uint8).astype(float)
    means = [sum(x[c::3]) / 64 for c in range(3)]
    sds = [(sum((v - m) ** 2 for v in x[c::3]) / 64) ** 0.5 for c, m in enumerate(means)]
    bins = [sum(1 for v in x if int(v) // 32 == b) for b in range(8)]
    assert got[8].feature == "rgb=" + ",".join(f"{m:.3f}:{d:.3f}" for m, d in zip(means, sds, strict=True)) + ";hist=" + ",".join(map(str, bins))
    assert media.document_media(empty).isEmpty()


def test_html_sequences(spark):
    html = "<p>a <b>b</b></p><figure><img src=x alt=y><figcaption>cap &amp; c</figcaption></figure><script>no</script><img src=z>tail"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")
    rows = media.sequences(media.parse(pages)).collect()
    assert [(p.kind, p.text, p.ref, p.caption) for p in rows[0].parts] == [("text", "a b", None, None), ("media", None, "x", "cap & c"), ("media", None, "z", None), ("text", "tail", None, None)]
    assert len(rows) == 1
    broken = {"<figure><img src=a><figcaption>c</figure><p>after</p>": [("media", None, "a", "c"), ("text", "after", None, None)], "<figcaption>x<p>y": [("text", "x y", None, None)], "<figure><figcaption>only</figcaption></figure>z": [("text", "only", None, None), ("text", "z", None, None)]}
    for page, want in broken.items():
        assert [x[1:] for x in media.read_html(page.replace("<p>y", " y"))] == want
    whole = media.read(pages).orderBy("page_id").collect()
    assert [len(r.parts) for r in whole] == [4, 0, 0] and [p.position for p in whole[0].parts] == [0, 1, 2, 3]


def test_hot_references(spark, monkeypatch):
    """A text that most documents have, others in a few, one of its own: all rows keep their number and values."""
    texts = ["hot"] * 300 + [f"t{i % 7}" for i in range(40)] + [None, "", "own\nlines"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {x: sorted(map(tuple, media.document_media(d).collect()), key=str) for x in (monkeypatch.setattr(media, "HOT", n) or n for n in (1024, 8, 1))}
    assert got[1024] == got[8] == got[1] and sorted(r[0] for r in got[8]) == list(range(len(texts)))
    assert {r[3] for r in got[8] if r[0] < 300} == {hashlib.sha256(b"hot" + b" " * 189).hexdigest()}


def brute_mix(rows):
    sized = [(d, s, len(words(t)), hashlib.md5(f"{d}#{t or ''}".encode()).hexdigest()) for d, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n, _ in sized if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= full
    return sized, size, target


def test_mixing(docs, empty, spark):
    rows = [(i, prose(int(rng.integers(0, 40)), i), (None, "a", "b", "c")[int(rng.integers(0, 4))]) for i in range(300)]
    d = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    sized, size, target = brute_mix(rows)
    got = mixing.mix(d).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, _, n, _ in sized)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.times * r.size and 0 <= r.times <= 2
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 80
    assert sum(r.taken for r in got) <= 1.5 * sum(size.values())
    assert mixing.mixed(d).count() == sum(r.times for r in got)
    again = sorted(tuple(r) for r in mixing.mix(d.repartition(7)).drop("source").collect())
    assert again == sorted(tuple(r) for r in mixing.mix(d).drop("source").collect())
    assert mixing.mix(docs).count() == len(TEXTS) + 1
    assert mixing.mixed(docs).count() == mixing.mix(docs).agg(F.sum("times")).first()[0]
    assert mixing.mix(empty).isEmpty()


def test_mixing_against_brute_force_queue(spark):
    """The queue itself: documents by finish time, each source twice, cut at the budget."""
    rows = [(i, prose(int(rng.integers(0, 40)), i), (None, "a", "b", "c")[int(rng.integers(0, 4))]) for i in range(300)]
    sized, size, target = brute_mix(rows)
    line, served = [], dict.fromkeys(size, 0)
    for d, s, n, k in sorted(sized, key=lambda x: x[3]):
        served[s] += n
        if n and target[s]:
            line += [((served[s] + p * size[s]) / target[s], (s is None, s or ""), k, p, d, n) for p in range(2)]
    want, used = dict.fromkeys((d for d, *_ in sized), 0), 0
    for *_, d, n in sorted(line):
        used += n
        want[d] += used <= 1.5 * sum(size.values())
    got = mixing.mix(spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)).collect()
    assert {r.doc_id: r.times for r in got} == want


def test_targets_of_ties(spark):
    """Sources of equal size and weight, one of them null, that stop together share nothing of what the others get."""
    for sizes in ([(None, 10), ("a", 10), ("b", 10), ("c", 10)], [("a", 5), ("b", 1), ("c", 1), (None, 5)], [("a", 0), ("b", 0), (None, 0)], [("a", 3)]):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
        names = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
        total, weight = sum(n for _, n in sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        low, high = 0.0, 1e9
        for _ in range(200):  # the level by bisection
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2 * n, weight[s] * mid) for s, n in sizes) < 1.5 * total else (low, mid)
        assert all(abs(got[s] - min(2 * n, weight[s] * high)) < 1e-6 for s, n in sizes), sizes


def test_sql_of_near_copies_and_mixing(spark, tmp_path):
    import duckdb

    from textgate.llm import queries

    base = [prose(int(n), 4000 + i) for i, n in enumerate(rng.integers(0, 60, 12))]
    texts = [None, "", " \t", "One two", "one  TWO"] + [" ".join(w if rng.random() > 0.01 else "x" for w in base[int(rng.integers(0, 12))].split()) for _ in range(80)]
    rows = [(i, t, "en", (None, "a", "b", "c", "d")[i % 5], 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, str(tmp_path)), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall()), name


def test_convolution_against_brute_force():
    """The merged look-up tables give what filters slid over one-hot bytes give."""
    r = np.random.default_rng(2)
    tables = [r.normal(0, 0.2, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    hidden = langid.FILTERS * len(langid.WIDTHS)
    net = langid.ByteConvNet(["a", "b", "c"], tables, r.normal(size=hidden).astype(np.float32), r.normal(size=(hidden, 3)).astype(np.float32), r.normal(size=3).astype(np.float32))
    texts = [bytes(r.integers(1, 256, int(n), dtype=np.uint8)) for n in (0, 1, 3, 255, 256, 257, 700)]
    want = []
    for t in texts:
        total = np.zeros(3)
        for at in range(0, len(t), langid.WINDOW):
            window = t[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            hot = np.eye(256)[list(window)]
            pooled = [max(float((hot[p : p + w] * f[:, :, k]).sum()) for p in range(langid.WINDOW - w + 1)) for w, f in zip(langid.WIDTHS, tables, strict=True) for k in range(langid.FILTERS)]
            logits = np.maximum(np.array(pooled) + net.shift, 0) @ net.weights + net.bias
            e = np.exp(logits - logits.max())
            total += e / e.sum() * len(t[at : at + langid.WINDOW])
        want.append(total / len(t) if t else total)
    got = net.predict(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, want, atol=1e-4)


def test_pipeline(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, prose(int(r.integers(50, 90)), 1000 + i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(60, rows[0][1], "en", "s0", 1), (61, None, "en", "s1", 0), (62, "12 34", "en", "s1", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        if i < 4:
            assert docs.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
        if i < 3:
            assert sorted(x.doc_id for x in docs.collect()) == (list(range(61)) if i == 0 else list(range(60)))
    assert docs.columns == ["doc_id", "ids", "n_tokens"]
