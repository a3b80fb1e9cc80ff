"""One format for what the extractors read: page trees, bundles and binary contexts, with what is wrong with each.

    spark.dataSource.register(Inputs)
    spark.read.format("fact_inputs").option("kind", "backend").load("/data/web_json")

Every row is an entry of an input, or a warning about one: `input` (its file), `entry` (its place there), `source_file`, `content`,
and `warning` and `message`, which are null for entries. One bad input costs its own rows and no others; parted() splits
entries from warnings after one pass.

Inputs are listed and sorted by the driver and dealt to partitions by size. Stores are reached through pyarrow's file systems
(local and mounted folders, and s3, gs, hdfs by URI); bundles that only Spark's own readers reach come as a table of texts to
parsed_bundles(), which does the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from factweave.functions import vocabulary as V
from factweave.sources.bundles import INPUT_TYPES

SCHEMA = "input string, entry int, source_file string, content string, warning string, message string"
#: Bytes of inputs in a partition.
PARTITION_BYTES = 32 << 20
#: Characters of bundles whose entries leave Python together; a longer bundle goes alone.
BATCH_CHARS = 4 << 20
# Where inputs lie by default, below a root; later lists are used where the earlier ones find nothing.
DEFAULT_GLOBS = {
    "config": [["output/web_json/*/web_server_config_sources.readable.json", "collector/output/web_json/*/web_server_config_sources.readable.json"]],
    "backend": [["output/web_json/*/web_backend_sources.readable.json"], ["collector/output/web_json/*/web_backend_sources.readable.json"]],
}
CONTEXT_SUFFIX = ".preprocessed.json"
Entry = tuple[int, str | None, str | None, str | None, str | None]


def is_page(name: str) -> bool:
    return PurePosixPath(name).suffix.lower().lstrip(".") in V.FRONTEND_SUFFIXES


def text_of(raw: bytes) -> str:
    """UTF-8 without a byte order mark; bytes that are none go."""
    return raw.decode("utf-8", "ignore").removeprefix("\ufeff")


def warned(kind: str, message: str, at: int = -1) -> Entry:
    return at, None, None, kind, message


def bundle_entries(text: str, kind: str) -> Iterator[Entry]:
    """entry, source_file, content, warning and message of what a bundle holds. Content is null where only a path is given.

    Values that are no text, as content, become text (of a backend bundle they are wrong). Entries that are no objects are
    passed over, in backend bundles with a warning.
    """
    try:
        bundle = json.loads(text)
    except ValueError as error:
        yield warned("invalid_json", str(error))
        return
    if not isinstance(bundle, dict):
        yield warned("invalid_json", "not an object")
        return
    given = bundle.get("input_type")
    if kind == "backend" and given != INPUT_TYPES[kind]:
        yield warned("unexpected_input_type", f"Expected input_type={INPUT_TYPES[kind]}, got {given!r}")
    if kind == "config" and given not in (None, INPUT_TYPES[kind]):
        yield warned("unexpected_input_type", f"Unexpected input_type: {given}")
        return
    files = bundle.get("files", None if kind == "backend" else [])
    if not isinstance(files, list):
        yield warned("invalid_files", "files is not a list")
        return
    for at, entry in enumerate(files):
        entry = entry if isinstance(entry, dict) else {}
        source, content = entry.get("source_file"), entry.get("content")
        if kind == "backend":
            whole = isinstance(source, str) and isinstance(content, str)
            yield (at, source, content, None, None) if whole else warned("invalid_file_entry", "files[] item missing string source_file/content", at)
            continue
        source = str(source or entry.get("path") or "")
        if content is not None:
            yield at, source or "<inline>", content if isinstance(content, str) else str(content), None, None
        elif source and kind == "frontend":
            yield at, source, None, None, None


class InputFiles(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class InputReader(DataSourceReader):
    """options: path, kind, format (auto, path, json), glob, root, partitionBytes."""

    def __init__(self, options: dict[str, str]):
        self.kind, self.format = options.get("kind", "frontend"), options.get("format", "auto")
        if self.kind not in (*INPUT_TYPES, "contexts") or self.format not in ("auto", "path", "json"):
            raise ValueError(f"unknown kind or format: {self.kind}, {self.format}")
        self.given, self.glob, self.root = options.get("path"), options.get("glob"), options.get("root", ".")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    @staticmethod
    def place(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+://|file:", path) else (fs.LocalFileSystem(), str(PurePosixPath(path)))

    def below(self, folder: str) -> list[fs.FileInfo]:
        store, path = self.place(folder)
        return [x for x in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.is_file]

    def matched(self, globs: list[str]) -> list[fs.FileInfo]:
        """Files below the root whose path, taken from there, has as many parts as a pattern and fits each of them."""
        _, root = self.place(self.root)
        fits = lambda parts, glob: len(parts) == len(glob) and all(map(fnmatchcase, parts, glob))
        patterns = [PurePosixPath(g).parts for g in globs]
        return [x for x in self.below(self.root) if any(fits(PurePosixPath(x.path).relative_to(root).parts, g) for g in patterns)]

    def inputs(self) -> list[fs.FileInfo]:
        if self.given is None:
            lists = [[self.glob]] if self.glob else DEFAULT_GLOBS.get(self.kind, [])
            found = next((files for globs in lists if (files := self.matched(globs))), [])
            if not found and self.kind != "config":
                raise FileNotFoundError(f"no inputs below {self.root}: {lists}")
            return found
        store, path = self.place(self.given)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such input: {self.given}")
        if info.is_file:
            return [info] if self.kind != "frontend" or self.as_json(path) or is_page(path) else []
        wanted = is_page if self.kind == "frontend" and self.format != "json" else lambda name: name.endswith(CONTEXT_SUFFIX if self.kind == "contexts" else ".json")
        found = [x for x in self.below(self.given) if wanted(x.path)]
        if not found and self.kind == "contexts":
            raise FileNotFoundError(f"no *{CONTEXT_SUFFIX} below {self.given}")
        return found

    def as_json(self, path: str) -> bool:
        return self.kind != "contexts" and (self.kind != "frontend" or self.format == "json" or self.format == "auto" and path.lower().endswith(".json"))

    def partitions(self) -> list[InputFiles]:
        packed, room = [], 0
        for info in sorted(self.inputs(), key=lambda x: x.path):
            if not packed or room < info.size:
                packed.append([])
                room = self.most
            packed[-1].append(info.path)
            room -= info.size
        return [InputFiles(files) for files in packed] or [InputFiles([])]

    def opened(self, path: str) -> bytes:
        store, _ = self.place(self.given or self.root)
        with store.open_input_stream(path) as stream:
            return stream.read()

    def entries(self, path: str) -> Iterator[Entry]:
        text = text_of(self.opened(path))
        if not self.as_json(path):
            yield 0, path, text, None, None
            return
        for at, source, content, warning, message in bundle_entries(text, self.kind):
            if warning is None and content is None:  # a page given by its path; one that isn't there is passed over
                try:
                    content = text_of(self.opened(source)) if is_page(source) else None
                except OSError:
                    content = None
                if content is None:
                    continue
            yield at, source, content, warning, message

    def read(self, partition: InputFiles) -> Iterator[tuple]:
        for path in partition.files:
            try:
                found = list(self.entries(path))
            except OSError as error:
                found = [warned("unreadable", str(error))]
            for entry in found:
                yield path, *entry


class Inputs(DataSource):
    """The format fact_inputs."""

    @classmethod
    def name(cls) -> str:
        return "fact_inputs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> InputReader:
        return InputReader(dict(self.options))


def read_inputs(spark: SparkSession, kind: str, path: str | None = None, **options: str) -> DataFrame:
    """Entries and warnings of the inputs at a path or, without one, at the default places below `root`."""
    spark.dataSource.register(Inputs)
    reader = spark.read.format("fact_inputs").option("kind", kind).options(**options)
    return reader.load(path) if path is not None else reader.load()


def bundle_batches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The rows of many bundles in one batch, as many as BATCH_CHARS of their texts give."""
    types = (pa.string(), pa.int32(), *[pa.string()] * 4)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["input", "entry", "source_file", "content", "warning", "message"])

    rows, held = [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if rows and held + len(text) > BATCH_CHARS:
                yield packed(rows)
                rows, held = [], 0
            rows += [(name, *entry) for entry in bundle_entries(text, kind)]
            held += len(text)
    if rows:
        yield packed(rows)


def parsed_bundles(bundles: DataFrame, kind: str, pages: DataFrame | None = None) -> DataFrame:
    """The same rows from a table of bundles: input, content (their text).

    pages (source_file, content): where frontend entries without content are looked up, by an equality join.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bundle_batches(batches, kind)

    rows = bundles.select(F.col("input").cast("string"), F.regexp_replace("content", "^\\uFEFF", "").alias("content")).mapInArrow(work, SCHEMA)
    if pages is not None:
        found = pages.select(F.col("source_file").alias("source_file"), F.col("content").alias("read"))
        rows = rows.join(found, "source_file", "left").withColumn("content", F.coalesce("content", "read")).select("input", "entry", "source_file", "content", "warning", "message")
    return rows.where("content IS NOT NULL OR warning IS NOT NULL")


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (input, source_file, content) and warnings (input, entry, warning, message) of rows that the caller has kept or
    may read twice."""
    return rows.where("warning IS NULL").select("input", "source_file", "content"), rows.where("warning IS NOT NULL").select("input", "entry", "warning", "message")
