"""Sources: raw pages, source bundles, binary contexts, candidate binaries, options.

Readers have explicit schemas; rows that don't fit become warnings instead of failures.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.operators.binary import CONTEXT

BUNDLE = "version string, input_type string, files array<struct<source_file:string,path:string,content:string>>, _corrupt_record string"
INPUT_TYPES = {"frontend": "web_frontend_sources", "config": "web_server_config_sources", "backend": "web_backend_sources"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """source_file and content of every page below a path, by suffix in any case; bytes that are no UTF-8 are dropped."""
    suffix = r"(?i)\.(" + "|".join(V.FRONTEND_SUFFIXES) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(suffix))

    @F.pandas_udf("string")
    def text(raw):
        return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return files.select(F.col("path").alias("source_file"), text("content").alias("content"))


def read_bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each JSON bundle: bundle_id (its file), version, input_type, files, _corrupt_record."""
    return spark.read.schema(BUNDLE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("bundle_id", F.col("_metadata.file_path"))


def sources_of(bundles: DataFrame, kind: str, pages: DataFrame | None = None) -> DataFrame:
    """bundle_id, source_file and content of the files of bundles.

    kind: "frontend", "config" or "backend". Content given in the bundle wins; a file without any is looked up among `pages`
    by its path. A configuration bundle must name its type or none, else it gives no rows (warnings_of() names it) and costs no other
    its own; its null contents are skipped.
    """
    if kind == "config":
        bundles = bundles.where(F.col("input_type").isNull() | (F.col("input_type") == INPUT_TYPES["config"]))
    files = bundles.select("bundle_id", F.explode("files").alias("f")).select("bundle_id", F.coalesce("f.source_file", "f.path", F.lit("<inline>")).alias("source_file"), F.col("f.path").alias("path"), F.col("f.content").alias("content"))
    if pages is not None:
        found = pages.select(F.col("source_file").alias("path"), F.col("content").alias("read"))
        files = files.join(found, "path", "left").withColumn("content", F.coalesce("content", "read")).drop("read")
    return files.where("content IS NOT NULL").select("bundle_id", "source_file", F.regexp_replace("content", "^\\uFEFF", "").alias("content"))


def warnings_of(bundles: DataFrame, kind: str) -> DataFrame:
    """bundle_id, type and message of what is wrong with bundles and their files."""
    wrong = bundles.where(F.coalesce(F.col("input_type") != INPUT_TYPES[kind], F.lit(False))).select("bundle_id", F.lit("input_type_mismatch").alias("type"), F.concat(F.lit("unexpected input_type: "), "input_type").alias("message"))
    empty = bundles.where("files IS NULL").select("bundle_id", F.lit("invalid_files").alias("type"), F.lit("files is not a list").alias("message"))
    bad = bundles.select("bundle_id", F.posexplode("files").alias("at", "f")).where("f.content IS NULL").select("bundle_id", F.lit("invalid_file").alias("type"), F.concat(F.lit("file without content at "), F.col("at").cast("string")).alias("message"))
    return wrong.unionAll(empty).unionAll(bad)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Binary contexts with doc_id (their file); *.preprocessed.json anywhere below the path."""
    reader = spark.read.schema(CONTEXT).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.preprocessed.json")
    return reader.json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def binary_kind(header: Column) -> Column:
    """elf, pe or macho by the first bytes, else null."""
    head = F.hex(F.substring(header, 1, 4))
    return F.when(head == "7F454C46", "elf").when(head.startswith("4D5A"), "pe").when(head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"), "macho")


def binary_bits(header: Column) -> Column:
    """32 or 64 by the class of the header, else null."""
    kind, head = binary_kind(header), F.hex(F.substring(header, 1, 4))
    elf = F.conv(F.hex(F.substring(header, 5, 1)), 16, 10).cast("int")
    at = F.conv(F.concat(*(F.hex(F.substring(header, k, 1)) for k in (64, 63, 62, 61))), 16, 10).cast("int")
    machine = F.hex(F.substring(header, at + 5, F.lit(2)))
    return F.when((kind == "elf") & (elf == 1), 32).when((kind == "elf") & (elf == 2), 64).when((kind == "pe") & machine.isin("6486", "64AA"), 64).when((kind == "pe") & machine.isin("4C01", "C001", "C401"), 32).when((kind == "macho") & head.isin("FEEDFACF", "CFFAEDFE"), 64).when((kind == "macho") & head.isin("FEEDFACE", "CEFAEDFE"), 32)


def binary_candidates(files: DataFrame, *, object_files: bool = True) -> DataFrame:
    """relative_path, size, kind and bits of files that are binaries: by magic, or by suffix with a NUL in the first 64 bytes.

    files: relative_path, size, header (the first bytes).
    """
    name = F.lower(F.element_at(F.split("relative_path", "/"), -1))
    suffix = F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("none")
    rows = files.withColumn("suffix", suffix).where(~F.col("suffix").isin(V.BINARY_IGNORED))
    if not object_files:
        rows = rows.where("suffix <> 'o'")
    nul = F.hex(F.substring("header", 1, 64)).rlike("^(..)*?00")
    rows = rows.where(binary_kind(F.col("header")).isNotNull() | F.col("suffix").isin(V.BINARY_RUNNABLE) & nul)
    return rows.select("relative_path", "size", binary_kind(F.col("header")).alias("kind"), binary_bits(F.col("header")).alias("bits"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Candidates below a path; only the head of each file is kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return binary_candidates(files.select(F.col("path").alias("relative_path"), F.col("length").alias("size"), F.substring("content", 1, 1024).alias("header")))


def option(name: str, given: dict, configured: dict, default: object = None) -> object:
    """A setting from the caller, else from a configuration, else the default."""
    return next((d[name] for d in (given, configured) if d.get(name) is not None), default)


def empty_bundle(kind: str) -> str:
    """A bundle to fill in, as JSON."""
    return json.dumps({"version": "1.0", "input_type": INPUT_TYPES[kind], "files": [{"source_file": "", "content": ""}]}, indent=2)


def output_stem(relative_path: str) -> str:
    """File name for the facts of an input: its path in one piece."""
    return str(PurePosixPath(relative_path)).replace("/", ".").removesuffix(".preprocessed.json")


def needs_login(status: Column) -> Column:
    """Whether a recorded answer says that a page asks for a login."""
    return status.isin(401, 403)


def probe_results(answers: DataFrame) -> DataFrame:
    """Recorded answers to safe requests with `auth_required` and, where the page came from elsewhere, redirect_target.

    answers: url, method, status_code (0 or null: none came), final_url and response_length. Methods other than GET and HEAD have no row.
    """
    rows = answers.withColumn("method", F.upper("method")).where(F.col("method").isin("GET", "HEAD")).withColumn("status_code", F.coalesce("status_code", F.lit(0)))
    answered = F.col("status_code").between(1, 399)
    return rows.select(
        "url", "method", "status_code", F.when(answered & (F.col("final_url") != F.col("url")), F.col("final_url")).alias("redirect_target"), F.when(answered, F.coalesce("response_length", F.lit(0))).otherwise(0).alias("response_length"), needs_login(F.col("status_code")).alias("auth_required")
    )


def status_summary(status: DataFrame) -> DataFrame:
    """total, ok and non_ok of status rows."""
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("non_ok"))
