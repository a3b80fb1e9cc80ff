"""Artifact files: one JSON document for each input, written by tasks as streams and made visible at commit.

    spark.dataSource.register(Artifacts)
    pieces.write.format("fact_artifacts").option("layout", "backend").mode("append").save("/data/facts")

pieces() turns fact tables into rows (input, section_no, seq, item), sorted by input, so a task writes a document as its rows
pass and holds one item. Tasks write below `_staging`, under a name of their own; commit moves the files of tasks that ended
well to their places and then writes the manifest, so neither a killed task nor an aborted job leaves a file in it. Places follow
from the inputs' paths, by layout:

| layout   | file                                                                  | beside it |
|----------|-----------------------------------------------------------------------|-----------|
| frontend | `<path of the page in one piece>_<digest>.web_frontend_artifacts.json`  |           |
| config   | `<folder of the input>.web_server_config_artifacts.json`               |           |
| backend  | `<folder of the input>.<name without .readable.json>.artifacts.json`   | `manifest.json`, for several inputs |
| binary   | `<name without .preprocessed.json>.web_backend_binary_artifacts.json`  | `status_summary.json` |

A target that ends in .json is the file itself: a single input's (config, backend), or an array of all pages (frontend), whose
documents the committing process copies end to end as streams; many pages are better left as files.
Two inputs of one place are an error, found before anything is moved.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from factweave.functions import columns as C
from factweave.operators import backend, frontend, serverconfig
from factweave.sources.inputs import DEFAULT_GLOBS, InputReader

STAGING = "_staging"
COUNTED = {"binary": ["route_count", "handler_count", "param_count", "sink_count"]}


def place_of(layout: str, path: str) -> str:
    """Name of the file for an input."""
    own = PurePosixPath(path)
    if layout == "frontend":
        slug = re.sub(r"[^A-Za-z0-9._-]+", "_", path).strip("_")[-120:]
        return f"{slug}_{hashlib.sha1(path.encode()).hexdigest()[:10]}.web_frontend_artifacts.json"
    if layout == "config":
        return f"{own.parent.name}.web_server_config_artifacts.json"
    if layout == "backend":
        return f"{own.parent.name or 'root'}.{own.name.replace('.readable.json', '')}.artifacts.json"
    stem = own.name.removesuffix(".preprocessed.json") if own.name.endswith(".preprocessed.json") else own.stem
    return f"{stem}.web_backend_binary_artifacts.json"


@dataclass
class Written(WriterCommitMessage):
    """input, staged file, and what the status summary says of it."""

    files: list[tuple[str, str, dict]]


class Document:
    """A JSON object, two spaces a level, written section by section."""

    def __init__(self, stream, sections: list[tuple[str, bool]], depth: int = 0):
        self.stream, self.sections, self.next, self.open = stream, sections, 0, False
        self.pad = "  " * depth
        self.put("{")

    def put(self, text: str) -> None:
        self.stream.write(text.encode())

    def begin(self, number: int) -> None:
        """Close what is open and write the sections before this one, empty."""
        while self.next <= number:
            self.close()
            name, many = self.sections[self.next]
            self.put(("," if self.next else "") + f"\n{self.pad}  {json.dumps(name)}: ")
            if self.next < number:
                self.put("[]" if many else "null")
            self.next += 1
            self.open = False

    def close(self) -> None:
        if self.open:
            self.put(f"\n{self.pad}  ]")
        self.open = False

    def item(self, number: int, text: str) -> None:
        many = self.sections[number][1]
        fresh = self.next <= number
        if fresh:
            self.begin(number)
        shown = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        pad = self.pad + ("    " if many else "  ")
        if many:
            self.put("[" if fresh else ",")
            self.put(f"\n{pad}")
            self.open = True
        self.put(shown.replace("\n", f"\n{pad}"))

    def end(self) -> None:
        if self.next < len(self.sections):
            self.begin(len(self.sections) - 1)
            self.put("[]" if self.sections[-1][1] else "null")
        self.close()
        self.put(f"\n{self.pad}}}")


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.layout, self.target = options["layout"], options["path"].rstrip("/")
        self.sections = [(name, many) for name, many in json.loads(options["sections"])]
        self.single = self.target.endswith(".json")
        self.array = self.single and self.layout == "frontend"
        self.folder = str(PurePosixPath(self.target).parent) if self.single else self.target
        self.job, self.overwrite = uuid.uuid4().hex, overwrite

    def store(self) -> tuple[fs.FileSystem, str]:
        return InputReader.place(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self.store()
        own = f"{folder}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        files: list[tuple[str, str, dict]] = []
        document, stream, last = None, None, None
        for row in iterator:
            if document is None or row["input"] != last:
                if document is not None:
                    document.end()
                    stream.close()
                last, staged = row["input"], f"{own}/{len(files)}.json"
                stream = store.open_output_stream(staged)
                document = Document(stream, self.sections, 1 if self.array else 0)
                files.append((last, staged, {}))
            document.item(row["section_no"], row["item"])
            if self.sections[row["section_no"]][0] in ("summary", "binary"):
                files[-1][2][self.sections[row["section_no"]][0]] = json.loads(row["item"])
        if document is not None:
            document.end()
            stream.close()
        return Written(files)

    def places(self, files: list[tuple[str, str, dict]]) -> list[tuple[str, str, str, dict]]:
        """input, staged file, place and status, by input; each place once."""
        _, folder = self.store()
        if self.single and not self.array and len(files) > 1:
            raise ValueError(f"{len(files)} inputs for one file")
        name = lambda path: PurePosixPath(self.target).name if self.single else place_of(self.layout, path)
        out = [(path, staged, f"{folder}/{name(path)}", status) for path, staged, status in sorted(files, key=lambda f: f[0])]
        if not self.array and len({p for _, _, p, _ in out}) < len(out):
            raise ValueError("several inputs have one place")
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self.store()
        try:
            found = self.places([f for m in messages if m is not None for f in m.files])
            if self.array:
                self.join(store, found)
            for _, staged, place, _ in [] if self.array else found:
                store.move(staged, place)
            if self.layout == "backend" and not self.single:
                results = [{"input": path, "output": place} for path, _, place, _ in found]
                self.save(store, f"{folder}/manifest.json", {"version": "1.0", "batch_input_glob": DEFAULT_GLOBS["backend"][0][0], "produced_count": len(results), "results": results})
            if self.layout == "binary":
                rows = [{"preprocess_path": path, "output_path": place, "status": "ok", "binary": (s.get("binary") or {}).get("source_file"), **{c: (s.get("summary") or {}).get(c) for c in COUNTED["binary"]}} for path, _, place, s in found]
                self.save(store, f"{folder}/status_summary.json", {"total": len(rows), "ok": len(rows), "non_ok": 0, "results": rows})
        finally:
            self.clear()

    def join(self, store: fs.FileSystem, found: list[tuple[str, str, str, dict]]) -> None:
        """The staged documents end to end as an array, copied as streams."""
        _, folder = self.store()
        whole = f"{folder}/{STAGING}/{self.job}/whole.json"
        with store.open_output_stream(whole) as out:
            out.write(b"[")
            for k, (_, staged, _, _) in enumerate(found):
                out.write(b",\n  " if k else b"\n  ")
                with store.open_input_stream(staged) as part:
                    while block := part.read(1 << 20):
                        out.write(block)
            out.write(b"\n]" if found else b"]")
        store.move(whole, f"{folder}/{PurePosixPath(self.target).name}")

    @staticmethod
    def save(store: fs.FileSystem, path: str, content: dict) -> None:
        with store.open_output_stream(path) as out:
            out.write(json.dumps(content, ensure_ascii=False, indent=2).encode())

    def clear(self) -> None:
        store, folder = self.store()
        store.delete_dir_contents(f"{folder}/{STAGING}/{self.job}", missing_dir_ok=True)
        store.delete_dir(f"{folder}/{STAGING}/{self.job}") if store.get_file_info(f"{folder}/{STAGING}/{self.job}").type == fs.FileType.Directory else None

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class Artifacts(DataSource):
    """The format fact_artifacts."""

    @classmethod
    def name(cls) -> str:
        return "fact_artifacts"

    def schema(self) -> str:
        return "input string, section_no int, seq long, item string"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options), overwrite)


@dataclass
class Layout:
    """Sections of a document in order (name, whether it is a list), and their rows: input, order, item."""

    name: str
    sections: list[tuple[str, bool]]
    rows: list[DataFrame]

    def pieces(self) -> DataFrame:
        """input, section_no, order and item of all documents, dealt by input and sorted."""
        whole = None
        for number, ((_, many), rows) in enumerate(zip(self.sections, self.rows, strict=True)):
            own = rows.select("input", F.lit(number).alias("section_no"), F.col("order") if "order" in rows.columns else F.lit("").alias("order"), "item")
            whole = own if whole is None else whole.unionAll(own)
        return whole.repartition("input").sortWithinPartitions("input", "section_no", "order", "item")

    def write(self, spark: SparkSession, target: str) -> None:
        spark.dataSource.register(Artifacts)
        rows = self.pieces().select("input", "section_no", F.lit(0).cast("long").alias("seq"), "item")
        rows.write.format("fact_artifacts").option("layout", self.name).option("sections", json.dumps(self.sections)).mode("append").save(target)


def as_item(table: DataFrame, columns: list, order: list) -> DataFrame:
    """input, order and item: a row as JSON with its nulls."""
    return table.select("input", F.concat_ws(":", *order).alias("order"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("item"))


def constants(inputs: DataFrame, **values: str) -> list[tuple[tuple[str, bool], DataFrame]]:
    return [((name, False), inputs.select("input", F.lit(json.dumps(value)).alias("item"))) for name, value in values.items()]


def padded(column: str) -> Column:
    """A number as text that sorts as the number does."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def as_text(column: str) -> Column:
    """A string column as JSON."""
    whole = F.to_json(F.struct(F.col(column).alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def laid_out(name: str, parts: list[tuple[tuple[str, bool], DataFrame]]) -> Layout:
    return Layout(name, [section for section, _ in parts], [rows for _, rows in parts])


def backend_layout(parsed: DataFrame) -> Layout:
    """Documents of backend bundles. parsed: rows of read_inputs() or parsed_bundles(), which are read once for each table."""
    files = parsed.where("warning IS NULL")
    inputs = parsed.select("input").distinct()
    # a fact's file is told by its input and entry, so that two inputs may hold files of one name
    named = files.select(F.to_json(F.struct("input", "entry", "source_file")).alias("source_file"), "content")
    key = F.from_json("source_file", "input string, entry int, source_file string")
    parts = constants(inputs, version="1.0", input_type="web_backend_sources", artifact_type="web_backend_sources")
    count = files.groupBy("input").agg(F.count("*").alias("n"))
    parts.append((("source_count", False), inputs.join(count, "input", "left").select("input", F.coalesce("n", F.lit(0)).cast("string").alias("item"))))
    counts = backend.file_counts(named).withColumn("k", key).select("k.input", "k.entry", "bucket", "matches")
    counts = counts.groupBy("input", "entry").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "matches")))).alias("counts"))
    no_counts = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    lines = files.select("input", "entry", "source_file", F.size(C.lines_of(F.col("content"))).alias("line_count"))
    lines = lines.join(counts, ["input", "entry"], "left").withColumn("counts", F.coalesce("counts", no_counts))
    parts.append((("files", True), as_item(lines, ["source_file", "line_count", "counts"], [padded("entry")])))
    totals = None
    for table in ("handlers", "routes", "route_mappings", "params", "constraints", "config_accesses", "sinks", "auth_hints", "state_hints", "strings", "references"):
        found = backend.facts(named, table).withColumn("k", key)
        own = [c for c in found.columns if c not in ("source_file", "line", "snippet", "k")]
        evidence = F.struct(F.col("k.source_file").alias("source_file"), "line", "snippet").alias("evidence")
        found = found.withColumn("input", F.col("k.input")).withColumn("entry", F.col("k.entry"))
        parts.append(((table, True), as_item(found, [*own, F.col("k.source_file").alias("source_file"), evidence], [padded("entry"), padded("line")])))
        part = found.groupBy("input").agg(F.count("*").alias("facts")).withColumn("table", F.lit(table))
        totals = part if totals is None else totals.unionByName(part)
    wrong = parsed.where("warning IS NOT NULL")
    parts.append((("parse_warnings", True), as_item(wrong, [F.col("warning").alias("type"), "message"], [padded("entry")])))
    totals = totals.groupBy("input").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", "facts")))).alias("counts"))
    skipped = parsed.groupBy("input").agg(F.count_if(F.col("warning").isNull()).alias("parsed_files"), F.count_if(F.col("warning") == "invalid_file_entry").alias("skipped_files"))
    summary = skipped.join(totals, "input", "left").withColumn("total_files_in_input", F.col("parsed_files") + F.col("skipped_files"))
    parts.append((("summary", False), as_item(summary, ["parsed_files", "skipped_files", "total_files_in_input", "counts"], [])))
    return laid_out("backend", parts)


def config_layout(parsed: DataFrame) -> Layout:
    """Documents of configuration bundles; an input of another type has a document with its warning alone."""
    inputs = parsed.select("input").distinct()
    sources = parsed.where("warning IS NULL").select(F.col("input").alias("bundle_id"), "source_file", "content")
    parts = constants(inputs, version="1.0", artifact_type="web_server_config")
    parts.append((("source_input", False), inputs.select("input", as_text("input").alias("item"))))
    found = serverconfig.facts(sources)
    for name, table in found.items():
        table = table.withColumnRenamed("bundle_id", "input")
        parts.append(((name, True), as_item(table, [c for c in table.columns if c != "input"], [])))
    wrong = parsed.where("warning IS NOT NULL")
    parts.append((("parse_warnings", True), as_item(wrong, ["source_file", "message"], [padded("entry")])))
    n_warnings = parsed.groupBy(F.col("input").alias("bundle_id")).agg(F.count("warning").alias("parse_warnings_count"))
    summary = n_warnings.join(serverconfig.summary(sources), "bundle_id", "left").withColumnRenamed("bundle_id", "input")
    numbers = [F.coalesce(F.col(name), F.lit(0)).alias(f"{name}_count") for name in found]
    listed = lambda c, kind: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast(kind)).otherwise(F.split(c, "[|]").cast(kind))
    parts.append((("summary", False), as_item(summary, [*numbers, "parse_warnings_count", listed("server_types", "array<string>").alias("server_types"), listed("ports", "array<int>").alias("listener_ports")], [])))
    return laid_out("config", parts)


def frontend_layout(parsed: DataFrame) -> Layout:
    """Documents of pages."""
    sources = parsed.where("warning IS NULL").select(F.col("source_file"), "content")
    inputs = sources.select(F.col("source_file").alias("input")).distinct()
    parts = constants(inputs, version="1.0") + [(("source_file", False), inputs.select("input", as_text("input").alias("item")))]
    events = frontend.html_events(sources)
    for name, table in frontend.facts(sources, events).items():
        table = table.withColumnRenamed("source_file", "input")
        parts.append(((name, True), as_item(table, [c for c in table.columns if c != "input"], [])))
    for name, table in (("ui_context", frontend.ui_context(sources, events)), ("references", frontend.references(sources, events))):
        own = next(c for c in table.columns if c != "source_file")
        parts.append(((name, True), table.select(F.col("source_file").alias("input"), as_text(own).alias("item"))))
    return laid_out("frontend", parts)
