"""Sinks: fact tables as Parquet or JSON, artifacts as one JSON document, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import crawl
from factweave.session import stored


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each fact table as Parquet below the folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def artifacts(tables: dict[str, DataFrame], key: str, version: str = "1.0") -> DataFrame:
    """key and `artifact`: a JSON document for each input, with an array for each table. Nulls are kept."""
    out = None
    for name, table in tables.items():
        rows = table.groupBy(key).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*(c for c in table.columns if c != key)), {"ignoreNullFields": "false"}))).alias(name))
        out = rows if out is None else out.join(rows, key, "full")
    parts = [F.concat(F.lit(f'"{name}":['), F.array_join(F.coalesce(name, F.array().cast("array<string>")), ","), F.lit("]")) for name in tables]
    document = F.concat(F.lit(f'{{"version":"{version}",'), F.concat_ws(",", *parts), F.lit("}"))
    return out.select(key, document.alias("artifact"))


def write_artifacts(documents: DataFrame, folder: str) -> None:
    """JSON documents, one a line."""
    documents.select(F.col("artifact").alias("value")).write.mode("overwrite").text(folder)


def manifest(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, table and facts: how much each input gave."""
    out = None
    for name, table in tables.items():
        rows = table.groupBy(key).agg(F.count("*").alias("facts")).withColumn("table", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_crawl(pages: DataFrame, folder: str, base_url: str, proxy_url: str = "") -> None:
    """What a crawl leaves below the folder, each written by as many tasks as it needs: pages, endpoints and seed_templates as JSON lines, a
    summary of one JSON row, and a report as text. pages: url, html and, if recorded, status_code and content_type."""
    spark = pages.sparkSession
    events = stored(crawl.page_events(pages))
    found = stored(crawl.forms(pages, events))
    points = stored(crawl.endpoints(pages, found))
    crawl.records(pages, events).write.option("ignoreNullFields", "false").json(f"{folder}/pages")
    points.orderBy("method", "path").write.json(f"{folder}/endpoints")
    crawl.templates(found).write.option("ignoreNullFields", "false").json(f"{folder}/seed_templates")
    total = pages.select(F.lit("page_count").alias("of")).unionAll(points.select(F.lit("endpoint_count"))).unionAll(found.select(F.lit("form_template_count")))
    counts = total.agg(*(F.count_if(F.col("of") == c).alias(c) for c in ("page_count", "endpoint_count", "form_template_count")))
    summary = counts.select(F.lit(base_url).alias("base_url"), F.lit(proxy_url).alias("proxy_url"), F.unix_timestamp(F.current_timestamp()).alias("generated_at"), *counts.columns)
    summary.coalesce(1).write.json(f"{folder}/summary")
    row = spark.read.schema(summary.schema).json(f"{folder}/summary").first()
    head = [f"Base URL: {base_url}", f"Proxy URL: {proxy_url}", f"Pages crawled: {row.page_count}", f"Endpoints discovered: {row.endpoint_count}", f"Form templates: {row.form_template_count}", "", "Top endpoints:"]
    top = points.orderBy("method", "path").limit(20).select(F.concat_ws(" ", F.lit("-"), "method", "path", F.when(F.col("risky"), "risky")).alias("value"))
    lines = spark.createDataFrame([(x,) for x in head + [r.value for r in top.collect()]], "value string")
    lines.coalesce(1).write.text(f"{folder}/report")
