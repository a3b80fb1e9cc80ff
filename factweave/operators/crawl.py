"""Saved pages as a crawl: links, forms, request templates, endpoints, and reachability over the link graph.

Pages are (url, html); nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V
from factweave.operators.frontend import attribute, has
from factweave.operators.htmlevents import html_events
from factweave.operators.ranking import numbered
from factweave.session import shared_folder

#: Order in which a page's links are listed.
LINK_ORDER = ["a", "frame", "iframe", "script", "link"]


def page_events(pages: DataFrame) -> DataFrame:
    return html_events(pages.select(F.col("url").alias("source_file"), F.col("html").alias("content")))


def links(pages: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """url, pos (from 0) and link: same-host addresses of each page, each once, by kind of tag, then by place."""
    events = page_events(pages) if events is None else events
    rows = events.where("kind = 'ref' AND text <> ''").withColumn("link", C.normalized_url(F.col("source_file"), F.col("text"))).where("link IS NOT NULL").where(C.url_host(F.col("link")) == C.url_host(F.col("source_file")))
    order = F.array_position(F.array(*map(F.lit, LINK_ORDER)), F.col("tag"))
    rows = rows.groupBy(F.col("source_file").alias("url"), "link").agg(F.min(F.struct(order.alias("tag_no"), "pos")).alias("at"))
    listed = rows.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("at", "link"))).alias("all"))
    return listed.select("url", F.posexplode("all").alias("pos", "x")).select("url", "pos", "x.link")


def scripts(pages: DataFrame) -> DataFrame:
    """url and link of links whose path ends in .js."""
    return links(pages).where(C.url_path(F.col("link")).endswith(".js")).select("url", "link")


def forms(pages: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """A row for each form: url, form_no, form_id, action, method, enctype, risky, fields and seed_values."""
    events = page_events(pages) if events is None else events
    named = C.strip(F.coalesce(attribute("name"), F.lit("")))
    kind = F.lower(F.coalesce(F.nullif(attribute("type"), F.lit("")), F.col("tag")))
    chosen = F.get(F.filter("options", lambda o: o["selected"]), F.lit(0))["value"]
    picked = F.coalesce(F.nullif(chosen, F.lit("")), F.get("options", F.lit(0))["value"], F.lit(""))
    value = F.coalesce(attribute("value"), F.lit(""))
    seed = F.when(F.col("tag") == "select", picked).when(kind == "checkbox", F.when(has("checked"), value).otherwise("")).otherwise(value)
    safe = kind.isin(V.SAFE_INPUT_TYPES) | (F.col("tag") == "textarea")
    fields = events.where("kind IN ('field', 'select') AND form_no IS NOT NULL").withColumn("name", named).where("name <> ''")
    field = F.struct("pos", "name", "tag", kind.alias("type"), value.alias("value"), "options", has("checked").alias("checked"), F.when(safe, seed).alias("seed"))
    fields = fields.groupBy("source_file", "form_no").agg(F.sort_array(F.collect_list(field.dropFields("options"))).alias("fields"))
    rows = events.where("kind = 'form'").join(fields, ["source_file", "form_no"], "left")
    page = F.col("source_file")
    given = F.nullif(C.strip(F.coalesce(attribute("action"), F.lit(""))), F.lit(""))
    method = F.upper(F.coalesce(F.nullif(attribute("method"), F.lit("")), F.lit("GET")))
    form_id = F.coalesce(F.nullif(attribute("id"), F.lit("")), F.nullif(attribute("name"), F.lit("")), F.concat(F.lit("form_"), F.col("form_no").cast("string")))
    rows = rows.select(
        page.alias("url"), "form_no", form_id.alias("form_id"), F.coalesce(C.normalized_url(page, F.coalesce(given, page)), page).alias("action"), method.alias("method"),
        F.coalesce(F.nullif(attribute("enctype"), F.lit("")), F.lit("application/x-www-form-urlencoded")).alias("enctype"), F.coalesce("fields", F.array().cast("array<struct<pos:int,name:string,tag:string,type:string,value:string,checked:boolean,seed:string>>")).alias("fields"),
    )
    submits = F.transform(F.filter("fields", lambda f: f["type"] == "submit"), lambda f: f["name"])
    words = F.lower(F.concat_ws(" ", "action", "method", "form_id", submits))
    seeded = F.filter("fields", lambda f: f["seed"].isNotNull())
    # of several fields with one name the last counts
    entries = F.transform(F.filter(F.transform(seeded, lambda f, i: F.struct(f["name"].alias("k"), f["seed"].alias("v"), F.exists(F.slice(seeded, i + 2, F.size(seeded)), lambda g: g["name"] == f["name"]).alias("again"))), lambda e: ~e["again"]), lambda e: F.struct(e["k"], e["v"]))
    return rows.withColumn("risky", C.any_word(words, V.MUTATING_WORDS) | (F.col("method") != "GET")).withColumn("seed_values", F.map_from_entries(entries))


def templates(found: DataFrame) -> DataFrame:
    """One template for each form of forms(): kind, target, method, risky, source_page, form_id and seed_values."""
    return found.select(F.lit("form_template").alias("kind"), F.col("action").alias("target"), "method", "risky", F.col("url").alias("source_page"), "form_id", "seed_values")


def seed_templates(pages: DataFrame) -> DataFrame:
    """One template for each form of the pages."""
    return templates(forms(pages))


def endpoints(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """method, path, query_params (of the first address that made it), form_field_names, risky and source_urls.

    Addresses come in the order of `crawl_no` if pages have it, else of their URLs.
    """
    order = F.col("crawl_no") if "crawl_no" in pages.columns else F.lit(0)
    found = forms(pages) if found is None else found
    empty = F.array().cast("array<string>")
    names = F.array_sort(F.array_distinct(F.transform(C.query_pairs(F.col("url")), lambda p: p["name"])))
    own = pages.select(F.lit("GET").alias("method"), C.url_path(F.col("url")).alias("path"), names.alias("query_params"), empty.alias("form_field_names"), F.lit(None).cast("boolean").alias("risky"), F.col("url").alias("source_url"), F.struct(order.alias("page"), F.col("url"), F.lit(0).alias("form")).alias("seq"))
    made = found.join(pages.select("url", order.alias("page_no")), "url").select("method", C.url_path(F.col("action")).alias("path"), empty.alias("query_params"), F.transform("fields", lambda f: f["name"]).alias("form_field_names"), "risky", F.col("url").alias("source_url"), F.struct(F.col("page_no").alias("page"), F.col("url"), F.col("form_no").alias("form")).alias("seq"))
    return own.unionByName(made).groupBy("method", "path").agg(
        F.min_by("query_params", "seq").alias("query_params"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("form_field_names")))).alias("form_field_names"), F.bool_or("risky").alias("risky"), F.sort_array(F.collect_set("source_url")).alias("source_urls"),
    )


def records(pages: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row for each page: url, status_code, content_type, title, links, scripts, forms and snapshot_file. pages: url, html and, if they were
    recorded, status_code and content_type."""
    events = page_events(pages) if events is None else events
    given = lambda c, kind: F.col(c).cast(kind) if c in pages.columns else F.lit(None).cast(kind)
    linked = links(pages, events).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("l")).select("url", F.transform("l", lambda x: x["link"]).alias("links"))
    titles = events.where("kind = 'title'").groupBy(F.col("source_file").alias("url")).agg(F.max("text").alias("title"))
    found = forms(pages, events)
    filled = found.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("form_no", "form_id", "action", "method", "enctype", "risky", "fields"))).alias("forms"))
    rows = pages.select("url", given("status_code", "int").alias("status_code"), given("content_type", "string").alias("content_type")).join(titles, "url", "left").join(linked, "url", "left").join(filled, "url", "left")
    none = F.array().cast("array<string>")
    whole = rows.withColumn("links", F.coalesce("links", none)).withColumn("scripts", F.filter("links", lambda x: C.url_path(x).endswith(".js")))
    empty = F.array().cast(filled.schema["forms"].dataType)
    return whole.select("url", "status_code", "content_type", F.coalesce("title", F.lit("")).alias("title"), "links", "scripts", F.coalesce("forms", empty).alias("forms"), C.snapshot_name(F.col("url")).alias("snapshot_file"))


def counts(pages: DataFrame) -> DataFrame:
    """One row: pages, endpoints and forms."""
    found = forms(pages)
    rows = pages.select(F.lit("pages").alias("kind")).unionAll(found.select(F.lit("forms"))).unionAll(endpoints(pages, found).select(F.lit("endpoints")))
    return rows.agg(*(F.count_if(F.col("kind") == x).alias(x) for x in ("pages", "endpoints", "forms")))


def visits(edges: DataFrame, start: DataFrame, max_pages: int | None = None) -> DataFrame:
    """url, depth and visit_no (from 0) of every page that links lead to, in the order in which a queue takes them.

    edges: url, pos (order of a page's links), link; start: url, pos. A page is taken once, where it first stands in the queue: behind
    the pages of smaller depth, by the visit of the page that named it first and the place of the link there. The queue ends when it
    is empty or `max_pages` are taken, whether or not a page has links.

    A round is one depth: the pages taken last are joined with their links, each new page keeps its first place, and places become
    numbers by ranges (ranking.numbered). Rounds are appended to a folder and never written again; the driver gets a count of each.
    """
    spark = edges.sparkSession
    folder, taken, depth = shared_folder(spark), 0, 0
    found = start.groupBy("url").agg(F.min(F.struct(F.lit(0).cast("long").alias("by"), F.col("pos").cast("long").alias("pos"))).alias("place"))
    while True:
        ranked = numbered(found, ["place"], "visit_no")
        ranked.select("url", F.lit(depth).alias("depth"), (F.col("visit_no") + taken).alias("visit_no")).write.parquet(f"{folder}/depth={depth}")
        last = spark.read.parquet(f"{folder}/depth={depth}")
        fresh = last.count()
        taken += fresh
        if not fresh or max_pages is not None and taken >= max_pages:
            break
        known = spark.read.schema("url " + edges.schema["url"].dataType.simpleString()).parquet(*(f"{folder}/depth={k}" for k in range(depth + 1)))
        named = last.join(edges, "url").groupBy(F.col("link").alias("url")).agg(F.min(F.struct(F.col("visit_no").alias("by"), F.col("pos").cast("long").alias("pos"))).alias("place"))
        found = named.join(known, "url", "left_anti")
        depth += 1
    whole = spark.read.parquet(*(f"{folder}/depth={k}" for k in range(depth + 1))).select("url", "depth", "visit_no")
    return whole if max_pages is None else whole.where(F.col("visit_no") < max_pages)


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """url and depth of every page that links lead to, or of those within `max_depth` links. edges: url, link and, if max_pages is
    given, pos; start: url.

    Each round joins the pages found last with the links and takes away those known; rounds end when none is new. With max_pages
    the pages are those that a queue takes first (visits()); start pages and links without a place come in the order of addresses.
    """
    if max_pages is not None:
        placed = edges if "pos" in edges.columns else edges.distinct().withColumn("pos", F.row_number().over(Window.partitionBy("url").orderBy("link")))
        first = start if "pos" in start.columns else numbered(start.select("url").distinct(), ["url"], "pos")
        found = visits(placed, first, max_pages)
        return (found if max_depth is None else found.where(F.col("depth") <= max_depth)).select("url", "depth")
    spark = edges.sparkSession
    folder, depth = shared_folder(spark), 0
    found = start.select("url").distinct()
    while True:
        found.withColumn("depth", F.lit(depth)).write.parquet(f"{folder}/depth={depth}")
        last = spark.read.parquet(f"{folder}/depth={depth}")
        whole = spark.read.parquet(*(f"{folder}/depth={k}" for k in range(depth + 1))).select("url", "depth")
        if depth == max_depth or last.isEmpty():
            return whole
        found = last.join(edges, "url").select(F.col("link").alias("url")).distinct().join(whole.select("url"), "url", "left_anti")
        depth += 1


def report(pages: DataFrame, top: int = 20) -> DataFrame:
    """The first endpoints by method and path, as lines of a report."""
    return endpoints(pages).orderBy("method", "path").limit(top).select(F.concat_ws(" ", F.lit("-"), "method", "path", F.when(F.col("risky"), "risky")).alias("value"))
