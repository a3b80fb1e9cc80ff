"""Events of HTML documents: the one scan that needs a parser with state.

Documents are parsed where they are read, in Arrow batches, once; everything else works on the event rows with
DataFrame operations. Event rows: source_file, pos (order in the document), kind, tag, attrs, text, options, form_no,
form_action and title (the title so far).

kinds: form, field (input, textarea), select (at its end), ref (a, iframe, frame, script, link), meta, text (of the tag that
captured it), and one title at the end, with the whole title. In a text, the latest capturing tag replaces one still open.
A document that the parser can't take (it raises on some malformed declarations) has a single event of kind error, whose text
says why; all others are not touched by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "source_file string, pos int, kind string, tag string, attrs map<string,string>, text string, options array<struct<value:string,text:string,selected:boolean>>, form_no int, form_action string, title string"
CAPTURING = {"title", "h1", "h2", "h3", "label", "button", "option", "a", "li"}
LINKING = {"a": "href", "iframe": "src", "frame": "src", "script": "src", "link": "href"}
#: An attribute without a value, which is not the same as one that is absent.
BARE = "\0"


class Events(HTMLParser):
    """Collects the events of one document."""

    def __init__(self, source_file: str | None):
        super().__init__(convert_charrefs=True)
        self.source_file, self.rows = source_file, []
        self.title_parts: list[str] = []
        self.in_title = False
        self.forms, self.form = 0, None
        self.select: dict | None = None
        self.captured: tuple[str, dict, list[str]] | None = None
        self.option: dict | None = None

    def titled(self) -> str | None:
        return " ".join(x.strip() for x in self.title_parts if x.strip()) or None

    def emit(self, kind: str, tag: str, attrs: dict, text: str | None = None, options: list | None = None, form: dict | None = None) -> None:
        form = form or self.form or {}
        self.rows.append((self.source_file, len(self.rows), kind, tag, list(attrs.items()), text, options, form.get("no"), form.get("action"), self.titled()))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k.lower(): BARE if v is None else v for k, v in attrs}
        if tag == "title":
            self.in_title = True
        if tag in CAPTURING:
            self.captured = (tag, named, [])
        if tag == "form":
            self.forms += 1
            self.form = {"no": self.forms, "action": named.get("action", "").strip(BARE).strip() or None}
            self.emit("form", tag, named)
        elif tag in ("input", "textarea"):
            self.emit("field", tag, named)
        elif tag == "select":
            self.select = {"attrs": named, "options": [], "form": dict(self.form) if self.form else None}
        elif tag == "option" and self.select is not None:
            self.option = {"value": named.get("value", "").strip(BARE), "text": "", "selected": "selected" in named}
            self.select["options"].append(self.option)
        elif tag in LINKING:
            self.emit("ref", tag, named, named.get(LINKING[tag], "").strip(BARE).strip())
        elif tag == "meta":
            self.emit("meta", tag, named, named.get("content", "").strip(BARE).strip())

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag == "form":
            self.form = None
        elif tag == "option":
            self.option = None
        elif tag == "select" and self.select is not None:
            options = [(o["value"], " ".join(o["text"].split()), o["selected"]) for o in self.select["options"]]
            self.emit("select", tag, self.select["attrs"], options=options, form=self.select["form"] or {"no": None})
            self.select = self.option = None
        if self.captured and self.captured[0] == tag:
            text = " ".join(" ".join(self.captured[2]).split())
            if text:
                self.emit("text", tag, self.captured[1], text)
            self.captured = None

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title_parts.append(data)
        if self.captured:
            self.captured[2].append(data)
        if self.option is not None:
            self.option["text"] += " " + data


def events_of(source_file: str | None, content: str) -> list[tuple]:
    page = Events(source_file)
    try:
        page.feed(content)
        page.close()
    except Exception as error:  # whatever it is, it is this document's
        return [(source_file, 0, "error", "error", [], f"{type(error).__name__}: {error}", None, None, None, None)]
    page.emit("title", "title", {}, page.titled())
    return page.rows


def parse_warnings(events: DataFrame) -> DataFrame:
    """source_file and message of the documents that could not be parsed."""
    return events.where("kind = 'error'").select("source_file", F.col("text").alias("message"))


def html_events(sources: DataFrame) -> DataFrame:
    """Event rows of every source (source_file, content)."""

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source_file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += events_of(source_file, content or "")
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return sources.select(F.col("source_file").cast("string"), F.col("content").cast("string")).mapInArrow(work, SCHEMA)
