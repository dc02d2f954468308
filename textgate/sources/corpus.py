"""Corpus and registry sources. Schemas are explicit; what can't be read becomes rows, not errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ATTRIBUTIONS = "Subject string, title string, authors string, journal string, publication_date string, received_at string, DOI string, original_url string, relative_pdf_path string"
HISTORY = "date string, field string, papers int, words bigint, collocations_ge5 int, sections int, term_overlap double, score double, top_terms array<string>"
CASE_EDITS = "array<struct<span: array<int>, class: string, severity: string, accept: array<array<string>>>>"
CASE_META = "struct<field: string, error_class: string, severity: string, origin: string, no_edit: boolean, source_doc_id: string, protected_names: array<string>, review: string, approved_by: string>"
WORKS = "results array<struct<id: string, doi: string, best_oa_location: struct<license: string, pdf_url: string>, primary_location: struct<source: struct<issn_l: string, display_name: string>>>>"


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per whole text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, root: str, glob: str = "*.{pdf,txt}") -> DataFrame:
    """rel_path, field, ext, mtime, size, content of a corpus tree; the field is the first folder below the root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "")
    return raw.select(rel.alias("rel_path"), F.split(rel, "/")[0].alias("field"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def manifest(corpus: DataFrame) -> DataFrame:
    return corpus.select("rel_path", "mtime", "size", F.sha1("content").alias("sha1"))


def extract(corpus: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """rel_path, field, mtime, text, extract_ok. Plain text is decoded leniently; PDFs go through the given extractor. A
    failure or an empty text is a row with extract_ok false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for ext, content in zip(b["ext"], b["content"], strict=True):
                try:
                    texts.append(pdf(bytes(content)) if ext == "pdf" and pdf else bytes(content).decode("utf-8", "replace") if ext != "pdf" else None)
                except Exception:  # noqa: BLE001  an extractor may fail in any way; the row says so
                    texts.append(None)
            out = b[["rel_path", "field", "mtime"]].assign(text=texts)
            yield out.assign(extract_ok=[bool(t and t.strip()) for t in texts])

    return corpus.select("rel_path", "field", "mtime", "ext", "content").mapInPandas(run, "rel_path string, field string, mtime timestamp, text string, extract_ok boolean")


def first_of_field(corpus: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("field").orderBy("ext", "rel_path"))
    return corpus.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Rows of JSON lines with file and line (their order); malformed lines have corrupt = true and nulls."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.select("file", "line", (F.col("r._bad").isNotNull() | F.col("r").isNull()).alias("corrupt"), *[F.col(f"r.{c.strip().split(' ')[0]}") for c in schema.split(", ") if " " in c.strip()])


def case_folders(spark: SparkSession, root: str) -> DataFrame:
    """case_id, input, gold, edits, meta of folders that hold input.txt, gold.txt, edits.json and meta.json. Hidden folders
    and those named regressions or candidates are left out; unreadable JSON gives null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{input,gold}.txt").load(root)
    raw = raw.unionByName(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{edits,meta}.json").load(root))
    parts = raw.select(F.element_at(F.split("path", "/"), -2).alias("case_id"), F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("t"))
    parts = parts.where(~F.col("case_id").isin("regressions", "candidates") & ~F.col("case_id").startswith("."))
    one = lambda f: F.max(F.when(F.col("file") == f, F.col("t")))
    rows = parts.groupBy("case_id").agg(one("input.txt").alias("input"), one("gold.txt").alias("gold"), one("edits.json").alias("e"), one("meta.json").alias("m"), F.count("*").alias("n")).where("n = 4")
    edits = F.transform(F.from_json("e", CASE_EDITS), lambda x: F.struct(x["span"][0].alias("start"), x["span"][1].alias("end"), x["class"].alias("class"), x["severity"].alias("severity"), x["accept"].alias("accept")))
    return rows.select("case_id", "input", "gold", edits.alias("edits"), F.from_json("m", CASE_META).alias("meta"))


def edit_log(spark: SparkSession, root: str) -> DataFrame:
    """entry, date, original, corrected, meta (variant), skipped: folders <date>/<entry> with input.txt, corrected.txt and
    meta.json; a folder that lacks one or has unreadable metadata is skipped = true."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = raw.select(F.element_at(F.split("path", "/"), -3).alias("date"), F.element_at(F.split("path", "/"), -2).alias("entry"), F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("t"))
    one = lambda f: F.max(F.when(F.col("file") == f, F.col("t")))
    rows = parts.groupBy("date", "entry").agg(one("input.txt").alias("original"), one("corrected.txt").alias("corrected"), one("meta.json").alias("m"))
    meta = F.try_parse_json("m")
    return rows.select("entry", "date", "original", "corrected", meta.alias("meta"), (F.col("original").isNull() | F.col("corrected").isNull() | meta.isNull()).alias("skipped"))


def accepted_works(works: DataFrame, journals: DataFrame) -> DataFrame:
    """id, doi, pdf_url, issn_l, journal of works of an allowed journal that are CC BY and have a PDF."""
    w = works.select(F.explode("results").alias("w")).select("w.id", "w.doi", F.col("w.best_oa_location.license").alias("license"), F.col("w.best_oa_location.pdf_url").alias("pdf_url"), F.col("w.primary_location.source.issn_l").alias("issn_l"), F.col("w.primary_location.source.display_name").alias("journal"))
    return w.where("license = 'cc-by' and pdf_url is not null").join(journals.select("issn_l"), "issn_l", "left_semi")


def safe_urls(works: DataFrame, hosts: list[str], url: str = "pdf_url") -> DataFrame:
    u = F.col(url)
    part = lambda p: F.try_parse_url(u, F.lit(p))
    return works.where((part("PROTOCOL") == "https") & part("HOST").isin(hosts) & part("USERINFO").isNull() & ~u.rlike(r"^https://[^/]*:(?!443)\d+"))
