import json
import random
import re
import unicodedata
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from textgate.functions import align
from textgate.functions import text as T
from textgate.operators import attribution, benchmark, coverage, generate, history, invariants, journal, lint, mining, places, registry, render, routing, sections
from textgate.plans import catalogue
from textgate.sources import corpus, rules
from textgate.streaming import incremental


def docs(spark, *texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")


def pair(spark, original, corrected, **more):
    row = {"pair_id": 1, "original": original, "corrected": corrected, **more}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'bigint' if k == 'pair_id' else 'string'}" for k in row))


BASE = "The TiO2 film reached 95.3 % at 550 nm [12] and the index fell from 2.41 to 2.33 at 673 K in all runs."


def verdict(spark, original, corrected, **more):
    return invariants.verify_pairs(pair(spark, original, corrected, **more)).first()


def test_gate_integrity(spark):
    assert verdict(spark, BASE, BASE.replace("reached", "attained")).verdict == "PASS"
    bad = verdict(spark, BASE, BASE.replace("95.3", "95.8"))
    assert bad.verdict == "FAIL" and any("95.3" in v for v in bad.violations)
    assert verdict(spark, BASE, BASE.replace("[12] ", "")).verdict == "FAIL"
    rewritten = verdict(spark, "one two three four five six", "seven eight nine ten eleven twelve")
    assert rewritten.violations == ["CHANGE RATE"]
    assert verdict(spark, "하나 둘 셋 3시간", "one two three 3 h", type="A").verdict == "PASS"


def test_bound_is_below_the_rate(spark):
    p = pair(spark, "a b c d e f", "a c b d x f")
    assert invariants.change_rate_bound(p).first().bound <= invariants.change_rates(p).first().change_rate + 1e-12


def test_sections(spark):
    t = "Title\nAbstract\nShort.\n1. Introduction\nWords here.\nResults and Discussion\nMore.\nReferences\n[1] x"
    rows = sections.split_sections(docs(spark, t), "doc_id").orderBy("ord").collect()
    assert [r.role for r in rows] == ["frontmatter", "abstract", "introduction", "merged: results+discussion", "references"]
    assert [r.role for r in sections.split_sections(docs(spark, "no heading at all here."), "doc_id").collect()] == ["body"]
    assert "[1]" not in docs(spark, t).select(sections.body_text(F.col("text"))).first()[0]


def test_lints(spark):
    assert lint.notation_issues(docs(spark, "A bandgap and a band gap, a band-gap.")).first().family == "bandgap"
    assert lint.notation_issues(docs(spark, "bandgap only")).isEmpty()
    assert [r.acronym for r in lint.undefined_acronyms(docs(spark, "The FDTD run on DNA.")).collect()] == ["FDTD"]
    assert lint.undefined_acronyms(docs(spark, "The finite difference time domain (FDTD) run; FDTD again.")).isEmpty()
    r = lint.style_rates(pair(spark, "It works well.", "This result paves the way for it."), ["paves the way"]).first()
    assert (r.ai_tell_before, r.ai_tell_after, r.regressed) == (0, 1, True)


def entries(spark, *rows):
    return spark.createDataFrame([(1, i, json.dumps(e)) for i, e in enumerate(rows)], "pair_id bigint, ord int, e string").select("pair_id", "ord", F.from_json("e", journal.ENTRY).alias("entry"))


def test_journal(spark):
    p = pair(spark, "Each sample were heated twice, then it is stored.", "Each sample was heated twice, then it is stored.")
    good = {"kind": "changed", "original": "sample were", "corrected": "sample was", "rule": {"source": "r", "id": "x"}, "reason": "number"}
    assert journal.check_journal(p, entries(spark, good)).first().verdict == "PASS"
    assert journal.check_journal(p, entries(spark, good | {"original": "stored.", "corrected": "stored."})).first().uncovered == 1
    assert journal.check_journal(p, entries(spark, good | {"kind": "other"})).first().faults == 1
    assert journal.check_journal(p, entries(spark, good), spark.createDataFrame([("r", "only y")], "source string, content string")).first().faults == 1
    assert journal.check_journal(p, entries(spark).limit(0)).first().verdict == "PASS"
    spans = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 12, 13)], "pair_id int, s int, e int")
    assert sorted((r.s, r.e) for r in journal.merge_spans(spans).collect()) == [(0, 9), (12, 13)]


def test_mining_and_routing(spark):
    d = docs(spark, "We carefully measured the band. The film was carefully deposited.", "Quantum film film.")
    s = mining.field_stats(d).first()
    assert (s.words, s.sentences) == (13, 3) and s.we_per_10k > 0
    assert mining.top_terms(d, ["the"], 1).first().term == "film"
    assert {r.phrase for r in mining.phrase_bank(d, stop=["the"]).collect()} == {"carefully measured", "film deposited"}
    terms = spark.createDataFrame([("Physics", "quantum", 2), ("Materials", "film", 1), ("Optics", "the band", 2)], "field string, term string, weight int")
    got = {(r.doc_id, r.field): r.score for r in routing.field_scores(d, terms).collect()}
    assert got == {(0, "Materials"): 1, (0, "Optics"): 2, (1, "Physics"): 2, (1, "Materials"): 2}


def test_registry(spark):
    rows = spark.createDataFrame([("F", "FDTD", 1, 0, 0, "finite difference"), ("F", "FDTD", 2, 0, 0, "Finite Difference"), ("F", "CV", 1, 0, 0, "cyclic voltammetry"), ("F", "CV", 2, 0, 0, "coefficient of variation"), ("F", "CV", 3, 0, 0, "curriculum vitae")], "field string, acronym string, doc_id int, kind int, pos int, expansion string")
    got = {r.acronym: r for r in registry.fold(rows, "field", "acronym").collect()}
    assert (got["FDTD"].status, got["CV"].status, got["CV"].expansions_seen) == ("verified", "conflict", ["cyclic voltammetry", "coefficient of variation"])
    state = registry.learn_state(docs(spark, "The finite difference time domain (FDTD) of a bandgap, bandgap, band gap in Figure 3.")).first()
    assert (state.abbreviations, state.terms, state.figures) == ({"FDTD": "finite difference time domain"}, {"bandgap": "bandgap"}, [3])


def test_history(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "rel_path string, size int")
    old = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "rel_path string, size int")
    assert {tuple(r) for r in history.manifest_diff(now, old, facts=("size",)).collect()} == {("a", "arrived"), ("c", "changed"), ("d", "removed")}
    full = spark.range(1).select(history.coverage_score(F.lit(20), F.lit(20), F.lit(5), F.lit(100000), F.lit(1.0)).alias("x"))
    assert full.first().x == 100.0


def test_attribution(spark):
    m = spark.createDataFrame([("B", "t", "x", "2026", "d2", "p2"), ("A", "t", "y; z", "2025", "d1", "p1")], "Subject string, title string, authors string, publication_date string, DOI string, relative_pdf_path string")
    lic = spark.createDataFrame([("p1", "CC BY 4.0"), ("p2", "CC BY-NC-ND 4.0")], "relative_pdf_path string, licence string")
    rec = attribution.records(m, lic)
    assert {(r.record_id, r.path, r.status) for r in rec.collect()} == {("ART-0001", "p1", "active"), ("ART-0002", "p2", "excluded")}
    assert {r.doi for r in attribution.blocklist(spark.createDataFrame([("d2",)], "doi string"), rec).collect()} == {"d2"}


def case(spark, rows):
    t = "case_id string, input string, gold string, edits array<struct<start: int, end: int, class: string, severity: string, accept: array<array<string>>>>, meta struct<field: string, error_class: string, severity: string, origin: string, no_edit: boolean, source_doc_id: string, protected_names: array<string>, review: string, approved_by: string>"
    return spark.createDataFrame(rows, t)


def meta(no_edit=False, doc="d"):
    return ("f", "articles", "minor", "natural", no_edit, doc, [], "approved", "x")


def test_benchmark(spark):
    edits = [(1, 2, "articles", "minor", [["goes"]]), (3, 4, "articles", "major", [["schools"]])]
    cases = case(spark, [("a", "he go to school", "he goes to schools", edits, meta()), ("c", "one two three four", "one two three four", [], meta(True))])
    cands = spark.createDataFrame([("a", "he goes to school"), ("c", "one two three five")], "case_id string, text string")
    s = {r.case_id: r for r in benchmark.scores(cases, cands).collect()}
    assert abs(s["a"].score - 1 / 3) < 1e-12 and s["c"].changed == 1
    rep = benchmark.report(benchmark.scores(cases, cands)).first()
    assert abs(rep.swcr - 1 / 3) < 1e-12 and rep.fpr0 == 1.0 and rep.changed_per_1000 == 250.0
    assert benchmark.report(benchmark.scores(cases)).first().swcr == 1.0
    assert benchmark.case_faults(cases).isEmpty()
    assert benchmark.unmatched(cases, spark.createDataFrame([("z", "")], "case_id string, text string")).count() == 3
    assert generate.failing(benchmark.scores(cases, cands)).count() == 2
    one = lambda w, f: spark.createDataFrame([(w, f, "fp")], "swcr double, fpr0 double, fingerprint string")
    assert benchmark.regression(one(0.9, 0.0), one(1.0, 0.0)).first().regressed and not benchmark.regression(one(1.0, 0.01), one(1.0, 0.0)).first().regressed


def test_case_scores_by_rule(spark):
    """A lost invariant scores 0, no gold change is made by any candidate, spans take what is aligned with them."""
    edits = [(1, 2, "articles", "critical", [["goes"], ["went"]])]
    cases = case(spark, [("kept", "he go 3 km", "he goes 3 km", edits, meta()), ("lost", "he go 3 km", "he goes 3 km", edits, meta()), ("same", "a b c", "a b c", [], meta(True)), ("ins", "a b", "a x b", [(1, 1, "articles", "minor", [["x"]])], meta()), ("del", "a b c", "a c", [(1, 2, "articles", "minor", [[]])], meta())])
    cands = spark.createDataFrame([("kept", "he went 3 km"), ("lost", "he went 4 km"), ("same", "a b d"), ("ins", "a x b"), ("del", "a c")], "case_id string, text string")
    s = {r.case_id: r for r in benchmark.scores(cases, cands).collect()}
    assert {k: r.score for k, r in s.items()} == {"kept": 1.0, "lost": 0.0, "same": 1.0, "ins": 1.0, "del": 1.0}
    assert {k: r.eap for k, r in s.items()} == {"kept": 0.0, "lost": 0.0, "same": 1.0, "ins": 1.0, "del": 1.0}
    assert s["same"].changed == 1 and s["kept"].weight == 4.0 and s["kept"].source_tokens == 4
    mp = {r.case_id: r for r in benchmark.preservation(cases, cands, ["km"]).collect()}
    assert (mp["kept"].dice, mp["kept"].strict, mp["kept"].protected_names) == (1.0, True, True)
    assert mp["lost"].dice == 0.0 and not mp["lost"].strict and (mp["same"].dice, mp["same"].strict) == (1.0, True)


def test_alignment_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    text = lambda: " ".join(r.choice(list("abcd"), int(r.integers(0, 9))))
    rows = [(text(), text(), int(a), int(a + r.integers(0, 4))) for a in r.integers(0, 7, 200)]
    got = spark.createDataFrame(rows, "s string, o string, a int, b int").withColumn("p", align.paired("s", "o")).select("s", "o", "a", "b", align.aligned_tokens(F.col("p"), F.col("a"), F.col("b")).alias("x")).collect()
    for row in got:
        ops, out, want = align.opcodes(align.tokens(row.s), align.tokens(row.o)), align.tokens(row.o), []
        for tag, i1, i2, j1, j2 in ops:  # token by token
            if tag == "equal":
                want += [out[j1 + i - i1] for i in range(i1, i2) if row.a <= i < row.b]
            elif (tag == "insert" and row.a <= i1 <= row.b) or (tag == "replace" and i1 < row.b and row.a < i2):
                want += out[j1:j2]
        assert row.x == want


def test_occurrence_spans(spark):
    t = "ab ab  ab x.y x.y " + "z" * 300 + " \\E end"
    d = spark.createDataFrame([(t, ["ab"]), (t, ["ab", "x.y"]), (t, ["z"]), (t, []), (t, None), (t, ["\\E", ""])], "t string, n array<string>")
    got = [[(x.s, x.e) for x in r.s] for r in d.select(align.occurrence_spans(F.col("t"), F.col("n")).alias("s")).collect()]
    assert got == [[(0, 9)], [(0, 17)], [(18, 118)], [], [], [(319, 321)]]


def test_lint_rules(spark):
    d = docs(spark, "finite difference [3] (FDTD) and charge density wave (CDW). FDTD CDW XRD", "SEM SEM")
    assert {(r.doc_id, r.acronym): r.cnt for r in lint.undefined_acronyms(d).collect()} == {(0, "FDTD"): 2, (0, "XRD"): 1, (1, "SEM"): 2}
    assert registry.definitions(docs(spark, "rare metal (In) used. charge density wave (CDW)")).select("acronym").collect()[0][0] == "CDW"
    hit = lambda t, p: spark.createDataFrame([(t,)], "t string").where(F.col("t").rlike(lint.tell_pattern(p))).count()
    assert [hit(t, "shed/cast light") for t in ("they shed cast light", "SHEDS/CAST LIGHT on", "shed light", "shed / cast light")] == [1, 1, 0, 1]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["# Tells", '- "paves the way" and "old -> newer"', '  - "X plays a role" "tapestry of"', "## Non-tell phrases", '- "in this study"', "# More", '- "never read it"'])], "file string, line int, value string")
    assert [r.phrase for r in rules.tell_phrases(lines).orderBy("line").collect()] == ["paves the way", "tapestry of"]


def test_ablation(spark):
    arm = lambda x: spark.createDataFrame([(str(i), f"d{i % 2}", x) for i in range(4)], "case_id string, source_doc_id string, score double")
    p = benchmark.paired(arm(1.0), arm(0.9))
    assert abs(benchmark.summary(p).first().mean_difference - 0.1) < 1e-12
    ci = benchmark.bootstrap_interval(p, 200).first()
    assert ci.low > 0 and ci.high < 0.2
    assert abs(benchmark.mde_table(spark.createDataFrame([(100,)], "n int"), 0.35).first().mde - 0.09807) < 1e-9


def test_generators(spark):
    d = docs(spark, "Films are grown in the clean room now. More text.", "x")
    p = generate.control_passages(d)
    assert p.count() == 1
    made = {r.rule: r for r in generate.corruptions(p).collect()}
    assert made["P6"].input.startswith("Films is") and made["P5"].input == "Films are grown in clean room now."
    cases = spark.createDataFrame([(f"c{i}", "ab"[i % 2]) for i in range(5)], "case_id string, class string")
    assert sorted((r.case_id, r.field) for r in generate.round_robin(cases, ["x", "y"]).collect()) == [("c0", "x"), ("c1", "y"), ("c2", "y"), ("c3", "x"), ("c4", "x")]
    seq = generate.next_sequence(spark.createDataFrame([("d", 3)], "date string, seq int"), spark.createDataFrame([("d", "b"), ("d", "a"), ("e", "c")], "date string, slug string"))
    assert {(r.slug, r.seq) for r in seq.collect()} == {("a", 4), ("b", 5), ("c", 1)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "corpus/F").mkdir(parents=True)
    (tmp_path / "corpus/F/a.txt").write_bytes(b"caf\xff text")
    (tmp_path / "corpus/F/b.pdf").write_bytes(b"%PDF-broken")
    files = corpus.files(spark, str(tmp_path / "corpus"))
    assert {(r.rel_path, r.field) for r in corpus.manifest(files).join(files.select("rel_path", "field"), "rel_path").collect()} == {("F/a.txt", "F"), ("F/b.pdf", "F")}
    assert {(r.rel_path, r.extract_ok) for r in corpus.extract(files).collect()} == {("F/a.txt", True), ("F/b.pdf", False)}
    (tmp_path / "h.jsonl").write_text('{"date": "2026-01-01", "field": "F", "papers": 3}\nbroken\n')
    h = corpus.history(spark, str(tmp_path / "h.jsonl"))
    assert sorted((r.corrupt, r.papers) for r in h.collect() if not r.corrupt) == [(False, 3)] and h.where("corrupt").count() == 1
    (tmp_path / "cases/c1").mkdir(parents=True)
    for name, t in {"input.txt": "a b", "gold.txt": "a c", "edits.json": '[{"span": [1, 2], "class": "articles", "severity": "minor", "accept": [["c"]]}]', "meta.json": '{"field": "F", "no_edit": false}'}.items():
        (tmp_path / "cases/c1" / name).write_text(t)
    c = corpus.case_folders(spark, str(tmp_path / "cases")).first()
    assert (c.edits[0].start, c.edits[0].end, c.meta.field) == (1, 2, "F")
    (tmp_path / "o").mkdir()
    (tmp_path / "o/Physics.md").write_text('# Physics\n\n## Top terms\n- `Bandgap` (3)\n- `spin` — x\n\n## Tells\n- "paves the way" -> x\n')
    ls = rules.lines_of(spark, str(tmp_path / "o"))
    assert [r.term for r in rules.overlay_terms(ls).collect()] == ["Bandgap", "spin"]
    assert [r.term for r in rules.routing_terms(ls).collect()] == ["bandgap", "spin"]
    assert [r.phrase for r in rules.tell_phrases(ls).collect()] == ["paves the way"]
    d = docs(spark, "Some film and film here.")
    md = render.overlays(mining.field_stats(d), mining.top_terms(d, []), mining.phrase_bank(d)).first().markdown
    assert "`film` (2)" in md
    assert render.replace_block(render.replace_block("x", "b", "1"), "b", "2").count("start") == 1
    assert "&lt;" in render.html_table(spark.createDataFrame([("<",)], "a string"), "t")


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d = docs(spark, "a", "b")
    d.write.parquet(src)
    for want in (2, 3):
        incremental.arrivals(spark, src, d.schema, out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == want
        docs(spark, "c").write.mode("append").parquet(src)
    t = "acronym string, field string, expansion string, doc_id int, kind int, pos int"
    rows = [("CV", "F", "x rays", 2, 0, 0), ("CV", "F", "coil", 1, 0, 0), ("AB", "F", "Z one", 1, 0, 0), ("AB", "F", "z one two", 2, 0, 0)], [("AB", "F", "other", 3, 0, 0), ("NEW", "F", "n", 3, 0, 0), ("CV", "F", "third", 3, 0, 0)]
    for some in rows:
        spark.createDataFrame(some, t).coalesce(1).write.mode("append").parquet(str(tmp_path / "defs"))
        stream = spark.readStream.schema(t).parquet(str(tmp_path / "defs"))
        incremental.fold_definitions(stream, str(tmp_path / "reg"), str(tmp_path / "cp2")).awaitTermination()
    own = {r.acronym: (r.expansion, r.status, r.seen) for r in spark.read.parquet(str(tmp_path / "reg/v1")).collect()}
    whole = registry.fold(spark.createDataFrame(rows[0] + rows[1], t), "acronym", "field").collect()
    assert own == {r.acronym: (r.expansion, r.status, r.expansions_seen) for r in whole}
    assert own == {"CV": ("coil", "conflict", ["coil", "x rays"]), "AB": ("Z one", "conflict", ["Z one", "other"]), "NEW": ("n", "verified", ["n"])}


def test_catalogue_against_duckdb(spark):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "events", "pages", "conversations", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from textgate.plans.catalogue import ORACLES, QUERIES

    assert __spark_entry__.entry(spark).count() > 0
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert got.count() == len(want), name


ACCENTED = [("en", "Of the caf\u00e9 and of-the bar. It was quickly taken."), ("fr", "of the \ufb01n; OF\u00a0THE \u00e9t\u00e9 ofthe ofth\u00e9"), ("en", "\u201cof-the\u201d the-non \u2014 the non; they were seen"), ("de", "plain of the of-the"), (None, "It is \u00fcberly baked. \u201cWe\u201d are given."), ("en", ""), ("en", None)]


def tables(spark, path, **rows):
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def accented(spark, path):
    return tables(spark, path, documents=([(i, f"s{i % 2}", lang, x) for i, (lang, x) in enumerate(ACCENTED)], "doc_id bigint, source string, lang string, text string"))


def test_notation_over_all_documents(spark, tmp_path):
    at = accented(spark, tmp_path)
    per = {}
    for i, (_, x) in enumerate(ACCENTED):
        low = unicodedata.normalize("NFKC", x or "").lower()
        for f in catalogue.FAMILIES:
            for v in f:
                if n := len(re.findall(rf"(?<!\w){re.escape(v)}(?!\w)", low)):
                    per[i, f[0], v] = n
    want = Counter()
    for (i, f, v), n in per.items():
        want[f"s{i % 2}", f, v] += n
    assert {tuple(r[:3]): r.cnt for r in catalogue.notation_watch(spark, at).collect()} == want
    mixed = {k: n for k, n in Counter((i, f) for i, f, _ in per).items() if n >= 2}
    assert len(mixed) > 3 and {(r.doc_id, r.family): r.variants for r in catalogue.inconsistent_families(spark, at).collect()} == mixed


def test_passives_over_all_documents(spark, tmp_path):
    at = accented(spark, tmp_path)
    passive = r"(?i)(?<!\w)(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)(?!\w)"
    want = {i: None if x is None else len(re.findall(passive, x)) for i, (_, x) in enumerate(ACCENTED)}
    assert {r.doc_id: r.passives for r in catalogue.passive_counts(spark, at).collect()} == want and sum(n or 0 for n in want.values()) == 4
    for r in catalogue.field_stats(spark, at).collect():
        own = [i for i in want if f"s{i % 2}" == r.source]
        n_words = sum(len(re.findall("[A-Za-z][A-Za-z-]+", ACCENTED[i][1] or "")) for i in own)
        assert abs(r.passive_per_10k - sum(want[i] or 0 for i in own) * 10000 / n_words) < 1e-9


def test_benchmark_passages_glued_to_their_surroundings(spark, tmp_path):
    long, five, two, inner = "The quick brown fox jumps over the lazy dog", "one two three four five", "alpha beta", " led by space then six more words "
    texts = [f"say ({long}) now", f"x {long}.", f"x\u00a0{long}", f"it has {five}, yes", f"un{two}x", "alpha  beta", "a b c d e f g h", None, "", f"well{inner}on", "The quick brown fox jumps over the lazy cat", five.replace("two", "2")]
    rows = [(i, f"s{i % 2}", "en", x) for i, x in enumerate(texts)]
    passages = [long, five, two, inner, long, None]
    at = tables(spark, tmp_path, documents=(rows, "doc_id bigint, source string, lang string, text string"), benchmark=(list(enumerate(passages)), "item_id bigint, text string"))
    want = Counter(s for _, s, _, x in rows if not any(p in (x or "") for p in passages if p))
    assert sum(want.values()) == 6
    assert {r.source: r.papers for r in catalogue.excluded_by_benchmark_passage(spark, at).collect()} == want


PAPERS = [
    "Title of a paper\nwith a lead line\n\n1. Introduction\nThe finite element method (FEM) is widely used. FEM was given by others [3, 4]. We use XRD (x ray diffraction) and AFM.\n2 Methods\n\nLayers were carefully baked and taken. LED% and NMR_x AB%C ABé; OLED devices.\nResults and Discussion\nWe were shown it. UV and DNA and II\nReferences\n(Smith et al., 2020) XPS was used. We have been given it.",
    "Abstract\nfinite elements model (FEM) and scanning tools of the Dark Institute (DI). (FEM)STM (scanning tunnelling)STS (spectra of tunnels) and finite difference [3] (FDTD) FDTD",
    "no headings here (NH) at all, see NH and CVD. chemical vapour deposition (CVD) \r\nSummary \r\nresults (R2D2) in OK USA\x0bOutlook CVD (crystal violet dye) is made, was baked. \x85",
    "Findings", "", None, "results\n\nconclusion\nOrganic light emitting diode (OLED) is überly written. Licensed under CC BY-NC 4.0.", "Discussion\nit (a b c) (LED) light emitting diode (LED)\nLED (light-emitting diode). LED (large edge dislocation) https://creativecommons.org/licenses/by/4.0/",
]


def test_catalogue_on_papers_against_duckdb(spark, tmp_path):
    import duckdb

    rows = [(i, f"s{i % 2}", ["en", "fr", None][i % 3], x) for i, x in enumerate(PAPERS)] + [(len(PAPERS) + i, f"s{i % 2}", lang, x) for i, (lang, x) in enumerate(ACCENTED[2:])]
    at = tables(spark, tmp_path, documents=(rows, "doc_id bigint, source string, lang string, text string"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/documents.parquet/*.parquet'")
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    for name in ("section_split", "section_metrics", "undefined_acronyms", "abbrev_registry_fold", "passive_counts", "field_stats", "licence_families", "notation_watch", "inconsistent_families", "coverage_score"):
        got, want = catalogue.QUERIES[name](spark, at), con.sql(catalogue.ORACLES[name])
        cols = sorted(got.columns)
        mine = sorted((repr([plain(r[c]) for c in cols]) for r in got.collect()))
        assert mine == sorted(repr([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall()), name
        assert len(mine) > 1, name


def test_paths_and_redaction(spark):
    import posixpath

    paths = ["a/b.txt", "a/./b//c", "a/../b", "../x", "a/../../x", "/abs", "\\abs", "a\\..\\b\\c", "", ".", "..", "a/b/../../..", "..x/y", None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", T.relative_path(F.col("p")).alias("r")).collect()
    for i, r in got:
        p = paths[i]
        norm = posixpath.normpath(p.replace("\\", "/")) if p else None
        assert r == (None if not p or p[0] in "/\\" or norm == ".." or norm.startswith("../") else norm), p
    meta = {"a": "/home/x y/z.txt", "b": ["/q\"r", "s/t", 1], "/k": {"c": "/"}, "d": "see /etc"}
    hidden = "<redacted-absolute-path>"
    row = spark.createDataFrame([(json.dumps(meta),), (json.dumps(meta, indent=1),)], "j string").select(T.redacted(F.col("j"))).collect()
    assert all(json.loads(r[0]) == {"a": hidden, "b": [hidden, "s/t", 1], "/k": {"c": hidden}, "d": "see /etc"} for r in row)


def test_definition_contexts(spark):
    texts = [p for p in PAPERS if p] + ["x" * 200 + " the finite element\nmethod (FEM) and xAB (cde) AB (cde fgh) " + "y" * 30 + " FEM (finite elements)", "(a) " * 50, "no"]
    trimmed = lambda e, a: " ".join(e.split(" ")[next((i for i, w in enumerate(e.split(" ")) if w and w[0].lower() == a[0].lower()), len(e)) :])
    for text, got in zip(texts, docs(spark, *texts).orderBy("doc_id").select(T.definitions(F.col("text")).alias("d"), T.definition_contexts(F.col("text")).alias("c")).collect(), strict=True):
        want = [(m.group(2), text[max(0, m.start() - 80) : m.end()].replace("\n", " ")[-160:]) for m in re.finditer(r"([A-Za-z][A-Za-z -]{2,60}?) \(([A-Z][A-Za-z0-9]{1,9}%?)\)", text)]
        want += [(m.group(1), text[max(0, m.start() - 80) : m.end()].replace("\n", " ")[-160:]) for m in re.finditer(r"(?<!\w)([A-Z][A-Za-z0-9]{1,9}) \(([a-z][A-Za-z -]{2,60})\)", text)]
        assert list(zip((d.acronym for d in got.d), got.c, strict=True)) == want
    many = docs(spark, *[f"crystal violet dye{'s' * i} (CVD) and OK" for i in range(5)], None)
    rows = registry.contexts(many).orderBy("ord").collect()
    assert [(r.acronym, r.ord, r.doc_id) for r in rows] == [("CVD", 1, 4), ("CVD", 2, 3), ("CVD", 3, 2)] and rows[0].context == "crystal violet dyessss (CVD)"
    assert trimmed("of the crystal", "C") == "crystal"


def test_section_alignment(spark):
    p = pair(spark, "Lead\nMethods\nold\nResults\nsame\nMethods\nagain", "Results\nsame\nMethods\nfirst\nMethods\nlast\nOutlook\nnew")
    got = [tuple(r)[2:] for r in sections.align_sections(p).orderBy("ord").collect()]
    assert got == [("frontmatter", "frontmatter", "Lead", "", True), ("Methods", "methods", "old", "last", True), ("Results", "results", "same", "same", False), ("Methods", "methods", "again", "last", True), ("Outlook", "conclusion", "", "new", True)]
    assert [tuple(r)[2:] for r in sections.align_sections(pair(spark, None, None)).collect()] == [("body", "body", "", "", False)]


def test_coverage_records(spark):
    text = "Methods\n" + "We deposited thin layers and layers were quickly measured. " * 6 + "\nResults\nIt was shown."
    d = spark.createDataFrame([(1, "a", text), (2, "a", ""), (3, "b", None), (4, "c", " \n")], "doc_id bigint, source string, text string")
    before = spark.createDataFrame([("a", ["layers", "gone"])], "source string, top_terms array<string>")
    (r,) = coverage.coverage(d, before, stop=("and", "were")).collect()
    assert (r.source, r.papers, r.sections, r.collocations) == ("a", 2, 2, 2) and r.top_terms[0] == "layers"
    assert r.term_overlap == round(1 / len(r.top_terms), 3) and r.score == round(2 / 20 * 25 + 2 / 20 * 25 + 2 / 5 * 15 + r.words / 100000 * 15 + r.term_overlap * 20, 1)
    assert coverage.coverage(d, stop=("and",)).first().term_overlap is None
    assert {(x.source, x.major) for x in coverage.majors(d.groupBy("source").agg(F.count("*").alias("papers")), ["b", "z"]).collect()} == {("a", False), ("b", True), ("c", False)}
    steps = spark.createDataFrame([(x,) for x in (0.0, 3.0, 5.0, 12.0, 26.0, 100.0, 4999.0, 0.4)], "m double").select(coverage.nice_step(F.col("m"))).collect()
    assert [round(x[0], 9) for x in steps] == [1, 1, 1, 5, 10, 20, 1000, 0.1]


def test_registries_and_provenance(spark):
    reg = spark.createDataFrame([("a/./b.pdf",), ("c.pdf",)], "relative_pdf_path string")
    assert [r[0] for r in attribution.excluded_paths(reg).collect()] == ["a/b.pdf", "c.pdf"]
    with pytest.raises(Exception, match="escapes"):
        attribution.excluded_paths(spark.createDataFrame([("../b",)], "relative_pdf_path string")).collect()
    controls = spark.createDataFrame([("a/1", "a")], "rel_path string, field string")
    manifest = spark.createDataFrame([("a/1", "a", "cc-by")], "rel_path string, field string, licence string")
    assert attribution.with_provenance(controls, manifest).first().licence == "cc-by"
    for wrong in (manifest.withColumn("field", F.lit("b")), manifest.limit(0)):
        with pytest.raises(Exception, match="absent or of another field"):
            attribution.with_provenance(controls, wrong).collect()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.id for r in attribution.new_works(ids("a", "b", "b", None), ids("a")).collect() if r.id) == ["b"]
    assert benchmark.taxonomy_ids(ids("a", "b")).count() == 2
    for bad in (ids("a", "a"), ids("a", " "), ids("a", None), ids("x").limit(0)):
        with pytest.raises(ValueError, match="each once"):
            benchmark.taxonomy_ids(bad)
    review = lambda *x: spark.createDataFrame([((r,),) for r in x], "meta struct<review: string>")
    assert [benchmark.may_be_baseline(review(*x)).first()[0] for x in (("pending", "approved"), ("pending",), ())] == [True, False, False]


def test_journal_reports(spark):
    entry = lambda k, o: (k, o, "x", ("s", "i"), "r")
    rows = [(1, 0, entry("changed", "later")), (1, 1, entry("changed", "first")), (1, 2, entry("kept", "none")), (1, 3, entry("odd", None))]
    entries = spark.createDataFrame(rows, f"pair_id bigint, ord int, entry {journal.ENTRY}")
    assert {tuple(r) for r in journal.kind_counts(entries).collect()} == {("changed", 2), ("kept", 1), ("other", 1)}
    got = {r.ord: (r.offset, r.place) for r in journal.by_offset(pair(spark, "first and later", ""), entries).collect()}
    assert got == {0: (10, 2), 1: (0, 1), 2: (-1, 1), 3: (-1, 1)}


def test_golden_cases_and_candidates(spark):
    bad = BASE.replace("2.41", "2.14")
    triples = spark.createDataFrame([("ok", BASE, BASE.replace("in all runs", "in every run"), bad), ("slips", BASE, BASE, BASE), ("broken", BASE, bad, bad), ("missing", BASE, BASE, None)], "case_id string, input string, expected string, failure string")
    assert {r.case_id: r.status for r in benchmark.golden(triples, []).collect()} == {"ok": "OK", "slips": "FAIL", "broken": "FAIL", "missing": "FAIL"}
    meta = lambda **x: json.dumps({"field": "f", **x})
    rows = [("a/b", "one two", "one three", meta(source_doc_id="/abs/p")), ("a-b", "x", "x", meta(source_doc_id="doc 7")), ("c", "x", "y", meta(log="/tmp/l")), ("d", "x", "y", "{}")]
    entries = spark.createDataFrame(rows, "path string, original string, corrected string, meta string")
    got = {r.name: r for r in generate.candidates(entries, spark.createDataFrame([("a-b",), ("a-b-3",), ("c-2",)], "name string")).collect()}
    assert sorted(got) == ["a-b-2", "a-b-4", "c"]
    assert (got["a-b-2"].source_doc_id, got["a-b-4"].source_doc_id) == ("doc 7", "a/b") and len(got["a-b-4"].edits) == 1 and got["a-b-2"].edits == []
    assert json.loads(got["c"].meta)["log"] == "<redacted-absolute-path>" and {r.review for r in got.values()} == {"pending"}
    assert sorted(r.name for r in generate.candidates(entries).collect()) == ["a-b", "a-b-2", "c"]


def test_places_in_hot_groups(spark, monkeypatch):
    """Places and running sums go on over ranges, with ties, nulls and a group that has most rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(60)]), i, rng.randrange(5)) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, k int, id int, w int").repartition(6)
    for ranges in (1, 7, 256):
        monkeypatch.setattr(places, "RANGES", ranges)
        got = places.running(frame, ["g"], "k", "p", "id").collect()
        sums = {r.id: r.s for r in places.running(frame, ["g"], "k", "s", "id", weight="w").collect()}
        for g in ("hot", "a", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == [r[2] for r in own]
            assert sorted(r.p for r in got if r.g == g) == list(range(1, len(own) + 1))
            assert [sums[r[2]] for r in own] == list(accumulate(r[3] for r in own))
        for share in (0.0, 0.5, 0.975, 1.0):
            ranked = {r.g: r.value for r in benchmark.nearest_rank(frame, ["g"], "k", share).collect()}
            for g in ("hot", "a", None):
                values = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
                assert ranked[g] == values[int((len(values) - 1) * share)]
    assert places.running(frame.limit(0), ["g"], "k", "p").count() == 0


def test_merge_spans_without_a_beginning(spark, tmp_path):
    """Null beginnings come last, as in the query's SQL."""
    import duckdb

    rows = [(1, 1), (None, 1), (500, 1), (None, 1), (None, 2), (7, 2), (10, 2), (3, None), (None, 3)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalogue.merge_spans(spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(db.execute(catalogue.ORACLES["merge_spans"]).fetchall(), key=str)


def test_matcher_against_difflib(monkeypatch):
    from difflib import SequenceMatcher
    from time import perf_counter

    r = random.Random(3)
    whole = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for few in (0, 5, align.FEW_PAIRS):
        monkeypatch.setattr(align, "FEW_PAIRS", few)
        for t in range(400):
            v = "abcdef"[: r.randint(1, 6)]
            a = [r.choice(v) for _ in range(r.randint(0, 40))]
            b = [x if r.random() < 0.9 else r.choice(v) for x in a] if t % 2 else [r.choice(v) for _ in range(r.randint(0, 40))]
            assert align.opcodes(a, b) == whole(a, b)
    a, b = ([r.choice("abcdefghij") for _ in range(3000)] for _ in range(2))
    times = []
    for f in (align.opcodes, whole):
        began = perf_counter()
        times.append((f(a, b), perf_counter() - began))
    assert times[0][0] == times[1][0] and 3 * times[0][1] < times[1][1]  # long texts of frequent words: 12 times faster when measured


def test_changes_made_against_all_opcodes():
    r = random.Random(4)

    def spanned(ops, output, s, e):
        got = []
        for tag, i1, i2, j1, j2 in ops:
            if tag == "equal":
                got += output[j1 + max(s - i1, 0) : j1 + min(e, i2) - i1] if min(e, i2) > max(s, i1) else []
            elif (tag == "insert" and s <= i1 <= e) or (tag == "replace" and i1 < e and i2 > s):
                got += output[j1:j2]
        return got

    for _ in range(600):
        a, b, c = ([r.choice("abcd") for _ in range(r.randint(0, 25))] for _ in range(3))
        c = b[: len(b) // 2] + c if r.random() < 0.5 else c
        ops, gold = align.opcodes(a, b), align.opcodes(a, c)
        sizes = [(max(op[2] - op[1], op[4] - op[3], 1), spanned(ops, b, op[1], op[2]) == c[op[3] : op[4]]) for op in gold if op[0] != "equal"]
        assert align.changes_made(ops, b, gold, c) == (sum(n for n, same in sizes if same), sum(n for n, _ in sizes))
