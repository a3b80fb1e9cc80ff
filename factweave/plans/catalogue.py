"""The registered queries over the reference's operators and their SQL twins.

Each query reads whole tables. `operators` of an entry names the inventory lines it exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V
from factweave.operators import backend, binary, crawl, frontend, fuse, rules, serverconfig
from factweave.plans import corpora
from factweave.session import dealt, ensure_checkpoints, spread
from factweave.sources import bundles
from factweave.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        OPERATORS[function.__name__] = operators
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_file"), F.col("html").alias("content")))


# --- saved pages -------------------------------------------------------------------------------------------------------


LINKS = """l AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""
TITLE = "trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', '\"'), '\\s+', ' ', 'g'))"


@query(
    "H1 H9 H12 X16 F1 F2 A1 A6 N7 O4",
    f"""WITH {LINKS},
q AS (SELECT page_id, unnest(regexp_extract_all(html, '"((?:/[\\p{{L}}\\p{{N}}_./-]+|[\\p{{L}}\\p{{N}}_.-]+\\.(?i:cgi|asp|php|stm|shtml|htm|html)|\\./[\\p{{L}}\\p{{N}}_./-]+|\\.\\./[\\p{{L}}\\p{{N}}_./-]+)(?:\\?[^''"]*)?)"', 1)) AS href FROM pages),
a AS (SELECT page_id, href AS url, 'html_link_parser' AS source FROM l WHERE href <> '' UNION ALL SELECT page_id, href, 'regex_route_miner' FROM q),
r AS (SELECT * FROM a WHERE (starts_with(url, '/') OR starts_with(url, './') OR starts_with(url, '../') OR regexp_matches(url, '[\\p{{L}}\\p{{N}}_./-]+\\.(cgi|asp|php|htm|html)(\\?[^''"\\s<>]*)?$')) AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|map)$'))
SELECT CAST(page_id AS VARCHAR) AS source_file, url, 'GET' AS method, string_agg(DISTINCT source, '|' ORDER BY source) AS source, 'medium' AS confidence FROM r GROUP BY page_id, url""",
)
def page_routes_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of every page, fused."""
    return frontend.routes(pages_as_sources(spark, sf_dir)).select("source_file", "url", "method", "source", "confidence")


@query("H8 F5 O9", f"WITH {LINKS} SELECT CAST(page_id AS VARCHAR) AS source_file, href AS ref FROM l WHERE href <> '' AND NOT starts_with(href, '#') GROUP BY ALL")
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in links of every page, each once."""
    events = frontend.html_events(pages_as_sources(spark, sf_dir))
    return events.where("kind = 'ref' AND text <> '' AND NOT startswith(text, '#')").select("source_file", F.col("text").alias("ref")).distinct()


@query(
    "H11 H13 Q1",
    """WITH t AS (SELECT page_id, 'title:' AS p, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS x FROM pages UNION ALL SELECT page_id, 'heading:', unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) FROM pages UNION ALL SELECT page_id, 'a:', unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) FROM pages)
SELECT p AS kind, count(DISTINCT page_id) AS pages FROM t WHERE trim(x) <> '' GROUP BY p""",
)
def page_ui_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have a title, a heading and link captions."""
    rows = frontend.ui_context(pages_as_sources(spark, sf_dir)).withColumn("kind", F.regexp_extract("entry", "^(title:|heading:|a:)", 1))
    return rows.where("kind <> ''").groupBy("kind").agg(F.count_distinct("source_file").alias("pages"))


NORMAL = """n AS (SELECT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS link FROM l WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))"""


@query("W1 T24 F6 F7", f"WITH {LINKS}, {NORMAL} SELECT url, link FROM n GROUP BY ALL")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute same-host links of every page, each once."""
    return crawl.links(spread(table(spark, sf_dir, "pages").select("url", "html"))).select("url", "link")


@query("D10 W8", f"WITH {LINKS}, {NORMAL}, e AS (SELECT url, link FROM n GROUP BY ALL) SELECT link, count(*) AS linked_from FROM e GROUP BY link")
def link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages link to an address."""
    return page_links(spark, sf_dir).groupBy("link").agg(F.count("*").alias("linked_from"))


@query("T21 T26 K6", """SELECT url, substr(regexp_replace(regexp_replace(regexp_extract(url, '^(https?):', 1) || '_' || regexp_extract(url, '^https?://([^/?#]*)', 1) || '_' || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || '_' || regexp_extract(url, '\\?([^#]*)', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) || '_' || substr(sha1(url), 1, 10) || '.html' AS snapshot FROM pages""")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of page snapshots."""
    return table(spark, sf_dir, "pages").select("url", C.snapshot_name(F.col("url")).alias("snapshot"))


QUERY_PARTS = "p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS part FROM pages)"


@query("X19 T23 F3 T9", f"WITH {QUERY_PARTS} SELECT page_id, regexp_extract(part, '^([^=]*)', 1) AS name, regexp_extract(part, '^[^=]*=(.*)$', 1) AS value, CASE WHEN contains(regexp_extract(part, '^([^=]*)', 1), 'ip') THEN 'ipv4_or_host' ELSE 'string' END AS inferred_type FROM p WHERE part <> ''")
def page_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in the queries of page addresses."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(C.query_pairs(F.col("url"))).alias("p")).select("page_id", "p.name", "p.value").where(C.is_param_name(F.col("name")))
    return rows.withColumn("inferred_type", C.inferred_type(F.col("name"), F.lit("text")))


@query("W7 A18 Q28", "SELECT 'GET' AS method, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path, count(DISTINCT url) AS urls, min(url) AS first_url FROM pages GROUP BY ALL")
def endpoint_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of the crawl with the number of addresses behind them."""
    rows = crawl.endpoints(table(spark, sf_dir, "pages").select("url", "html"))
    return rows.select("method", "path", F.size("source_urls").cast("long").alias("urls"), F.element_at("source_urls", 1).alias("first_url"))


@query("O5 O6 K5", "WITH e AS (SELECT DISTINCT coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages) SELECT '- GET ' || path AS value FROM e ORDER BY path LIMIT 20")
def endpoint_report_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty endpoints of the crawl report."""
    return crawl.report(table(spark, sf_dir, "pages").select("url", "html"))


@query(
    "W8 J12 D9",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS url, o_orderkey % (SELECT count(*) FROM customer) AS link FROM orders), r(url, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT e.link, r.depth + 1 FROM r JOIN e ON r.url = e.url WHERE r.depth < 30)
SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def crawl_frontier_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reachable from every hundredth one, over the graph of orders; the frontier is joined, known pages are taken away."""
    ensure_checkpoints(spark)
    customers = table(spark, sf_dir, "customer")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_orderkey") % customers.count()).alias("link")).distinct()
    return crawl.reachable(edges, customers.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("url")))


@query("A19", "SELECT count(*) AS pages, count(*) + count(DISTINCT c_custkey % 15) AS endpoints, count(*) AS forms FROM customer")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, endpoints and forms of a crawl of pages with forms."""
    return crawl.counts(corpora.form_pages(spark, sf_dir).select("url", "html"))


# --- texts ------------------------------------------------------------------------------------------------------------


@query("N1 T1 D3", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS BIGINT) AS n_lines FROM s WHERE NOT (len(l) = 1 AND l[1] = '')")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.col("text").alias("content"))
    return rules.source_lines(docs).groupBy(F.col("source_file").alias("doc_id")).agg(F.max("line_no").cast("long").alias("n_lines"))


@query("T6 O8", "SELECT doc_id, CASE WHEN length(trim(line)) <= 220 THEN trim(line) ELSE substr(trim(line), 1, 217) || '...' END AS snippet, CAST(no AS INTEGER) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) WHERE trim(line) <> ''")
def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't blank, cut to a snippet."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.col("text").alias("content"))
    return rules.source_lines(docs).select(F.col("source_file").alias("doc_id"), C.snippet(F.col("line")).alias("snippet"), "line_no").where("snippet <> ''")


@query("B10 T17 F9", "SELECT CASE WHEN regexp_matches(lower(text), 'error|fail|invalid|unauthorized') THEN 'error_hint' WHEN regexp_matches(lower(text), 'success|ok|done') THEN 'success_hint' WHEN starts_with(text, '/') THEN 'path_or_route' ELSE 'generic' END AS string_type, count(*) AS texts FROM documents WHERE text IS NOT NULL GROUP BY 1")
def string_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of document texts, read as strings."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(C.string_type(F.col("text")).alias("string_type")).agg(F.count("*").alias("texts"))


@query(
    "P1 P2 F13 F15 V21 V22 V23",
    """WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN '/goform/' || c_mktsegment WHEN 1 THEN 'login failed.' WHEN 2 THEN 'save_' || c_custkey WHEN 3 THEN 'HTTP_HOST' WHEN 4 THEN 'ident_' || c_custkey WHEN 5 THEN '?' WHEN 6 THEN 'a b error' ELSE 'x' || c_custkey || '.cgi' END AS v FROM customer)
SELECT CASE k % 8 WHEN 0 THEN 'route' WHEN 1 THEN 'auth|response' WHEN 2 THEN 'state' WHEN 3 THEN 'env' WHEN 4 THEN 'identifier' WHEN 5 THEN '' WHEN 6 THEN 'response' ELSE 'route' END AS tags, count(*) AS strings FROM s GROUP BY 1""",
)
def string_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of strings derived from customers."""
    value = F.expr("CASE c_custkey % 8 WHEN 0 THEN '/goform/' || c_mktsegment WHEN 1 THEN 'login failed.' WHEN 2 THEN 'save_' || c_custkey WHEN 3 THEN 'HTTP_HOST' WHEN 4 THEN 'ident_' || c_custkey WHEN 5 THEN '?' WHEN 6 THEN 'a b error' ELSE 'x' || c_custkey || '.cgi' END")
    return table(spark, sf_dir, "customer").groupBy(F.array_join(C.string_tags(value), "|").alias("tags")).agg(F.count("*").alias("strings"))


@query(
    "J9 T14 V4 V5 Q4",
    """WITH w AS (SELECT p_partkey AS k, lower(p_name) || CASE p_partkey % 6 WHEN 0 THEN ' author' WHEN 1 THEN ' my-sid' WHEN 2 THEN ' inside' WHEN 3 THEN ' passwd login' WHEN 4 THEN ' commit' ELSE ' token restart' END AS t FROM part)
SELECT k, CASE WHEN contains(t, 'auth') THEN 'auth' WHEN contains(t, 'csrf') THEN 'csrf' WHEN contains(t, 'login') THEN 'login' WHEN contains(t, 'logout') THEN 'logout' WHEN contains(t, 'nonce') THEN 'nonce' WHEN contains(t, 'passwd') THEN 'password' WHEN contains(t, 'password') THEN 'password' WHEN contains(t, 'session') THEN 'session' WHEN regexp_matches(t, '(^|[^a-z0-9])sid([^a-z0-9]|$)') THEN 'session' WHEN contains(t, 'token') THEN 'token' WHEN contains(t, 'cookie') THEN 'cookie' END AS auth_kind,
CASE WHEN contains(t, 'apply') THEN 'apply' WHEN contains(t, 'commit') THEN 'save' WHEN contains(t, 'reboot') THEN 'reboot' WHEN contains(t, 'reset') THEN 'reset' WHEN contains(t, 'restart') THEN 'restart' WHEN contains(t, 'restore') THEN 'restore' WHEN contains(t, 'save') THEN 'save' WHEN contains(t, 'upgrade') THEN 'upgrade' END AS state_kind FROM w""",
)
def keyword_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First keyword of each family in texts derived from part names."""
    text = F.expr("lower(p_name) || CASE p_partkey % 6 WHEN 0 THEN ' author' WHEN 1 THEN ' my-sid' WHEN 2 THEN ' inside' WHEN 3 THEN ' passwd login' WHEN 4 THEN ' commit' ELSE ' token restart' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), C.keyword_kind(text, V.AUTH_WORDS).alias("auth_kind"), C.keyword_kind(text, V.STATE_WORDS).alias("state_kind"))


@query(
    "T9 V9 Q5",
    """WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'wan_ip' WHEN 1 THEN 'http_port' WHEN 2 THEN 'lan_mac' WHEN 3 THEN 'dhcp_enable' WHEN 4 THEN 'zip' WHEN 5 THEN 'host' ELSE 'x' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'number' WHEN 2 THEN 'password' WHEN 3 THEN 'file' ELSE 'text' END AS kind FROM part)
SELECT k, CASE WHEN kind = 'checkbox' THEN 'bool_or_enum' WHEN kind = 'number' THEN 'int' WHEN kind = 'password' THEN 'sensitive_string' WHEN kind = 'file' THEN 'file' WHEN name IN ('wan_ip', 'zip') THEN 'ipv4_or_host' WHEN name = 'http_port' THEN 'int' WHEN name = 'lan_mac' THEN 'mac' WHEN name = 'dhcp_enable' THEN 'bool_or_enum' ELSE 'string' END AS inferred_type FROM n""",
)
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of fields derived from parts."""
    name = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'wan_ip' WHEN 1 THEN 'http_port' WHEN 2 THEN 'lan_mac' WHEN 3 THEN 'dhcp_enable' WHEN 4 THEN 'zip' WHEN 5 THEN 'host' ELSE 'x' END")
    kind = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'number' WHEN 2 THEN 'password' WHEN 3 THEN 'file' ELSE 'text' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), C.inferred_type(name, kind).alias("inferred_type"))


@query(
    "T2 T3 T4 F10 F11",
    """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN '10.0.0.' || (o_orderkey % 200) WHEN 2 THEN '::1' WHEN 3 THEN '*' END AS address, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderkey % 60000 END AS INTEGER) AS port FROM orders""",
)
def address_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and ports of listen values derived from orders, with comments and quotes around them."""
    raw = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '"' || (o_orderkey % 60000) || '";' WHEN 1 THEN '10.0.0.' || (o_orderkey % 200) || ':' || (o_orderkey % 60000) || '; # c' WHEN 2 THEN '[::1]:' || (o_orderkey % 60000) WHEN 3 THEN 'http://*:' || (o_orderkey % 60000) || ' // x' ELSE 'none' END""")
    at = C.address_and_port(C.without_comment(raw))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), at["address"].alias("address"), at["port"].alias("port"))


# --- backend source -----------------------------------------------------------------------------------------------------


SRC = "src AS (SELECT 'mod' || (p_partkey // 50) || '.c' AS source_file, p_partkey AS k, p_size AS s, CAST((row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1) * 12 AS INTEGER) AS b FROM part)"


def backend_facts(table_name: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return backend.facts(corpora.backend_sources(spark, sf_dir), table_name).select("source_file", *columns, "line")

    run.__doc__ = f"Fact table {table_name} of C text derived from parts."
    run.__name__ = f"src_{table_name}"
    return run


def src_sql(rows: list[str], columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT source_file, {r}, b + {n} AS line FROM src" for r, n in ((r.rsplit("@", 1)[0], r.rsplit("@", 1)[1]) for r in rows))
    names = ", ".join(columns)
    return f"WITH {SRC}, f AS ({parts}) SELECT source_file, {names}, CAST(min(line) AS INTEGER) AS line FROM f GROUP BY source_file, {names}"


for operators, name, columns, rows in (
    ("B1 V10 G2", "handlers", ["handler", "kind"], ["'formH' || (k % 90) AS handler, 'registration' AS kind@2", "'page' || (k % 60) || '_handler', 'dispatch_table'@3", "'set' || (k % 30) || '_cgi', 'handler_symbol'@4"]),
    ("B1", "route_mappings", ["route", "handler"], ["'form' || (k % 120) AS route, 'formH' || (k % 90) AS handler@2", "'page' || (k % 60), 'page' || (k % 60) || '_handler'@3"]),
    ("B2 V11", "routes", ["route", "kind", "dispatch_key"], ["'form' || (k % 120) AS route, 'handler_linked' AS kind, CAST(NULL AS VARCHAR) AS dispatch_key@2", "'page' || (k % 60), 'handler_linked', NULL@3", "'/status' || (k % 25) || '.asp', 'cgi_asp_stm_literal', NULL@11"]),
    ("B3 T15 Q36 Q37", "params", ["param", "read_api", "param_source", "default_value"], ["'p' || (k % 200) AS param, 'websGetVar' AS read_api, 'unknown' AS param_source, '\"d' || (k % 7) || '\"' AS default_value@5", "'form' || (k % 120), 'websFormDefine', 'body', NULL@2"]),
    ("B4 V13", "constraints", ["constraint_type", "api", "target", "operator", "value", "extra"], ["'strlen_compare' AS constraint_type, CAST(NULL AS VARCHAR) AS api, 'v' AS target, '>' AS operator, CAST(s AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS extra@6", "'int_cast', 'atoi', 'v' || (k % 5), NULL, NULL, NULL@7", "'numeric_boundary', NULL, 'n', '==', CAST(k % 13 AS VARCHAR), NULL@12"]),
    ("B5 T7 T16 Q17", "config_accesses", ["api", "access_type", "config_key", "raw_args"], ["'nvram_set' AS api, 'set' AS access_type, 'key' || (k % 80) AS config_key, '\"key' || (k % 80) || '\", v' AS raw_args@8"]),
    ("B6 V16 Q19", "sinks", ["sink_category", "api"], ["'command' AS sink_category, 'system' AS api@9", "'state', 'reboot'@12"]),
    ("B7 V18 Q20", "auth_hints", ["keyword"], ["'login' AS keyword, b AS x@10", "'token', b@10"]),
    ("B8 V19", "state_hints", ["keyword"], ["'reboot' AS keyword, b AS x@12"]),
    ("B9", "references", ["reference_type", "value"], ["'include' AS reference_type, 'h' || (k % 40) || '.h' AS value@1"]),
    ("B10 T17 V20", "strings", ["string", "string_type"], [f"{v} AS string, '{t}' AS string_type@{n}" for v, t, n in (("'h' || (k % 40) || '.h'", "generic", 1), ("'form' || (k % 120)", "generic", 2), ("'page' || (k % 60)", "generic", 3), ("'p' || (k % 200)", "generic", 5), ("'key' || (k % 80)", "generic", 8), ("'login'", "generic", 10), ("'/status' || (k % 25) || '.asp'", "path_or_route", 11))]),
):
    sql = src_sql(rows, columns)
    if name == "strings":
        sql = sql.replace("FROM f GROUP", "FROM f WHERE length(string) >= 4 GROUP")
    if name in ("auth_hints", "state_hints"):
        sql = sql.replace("CAST(min(line) AS INTEGER) AS line FROM f GROUP BY source_file, keyword", "CAST(line AS INTEGER) AS line FROM f")
    query(operators, sql)(backend_facts(name, columns))


@query(
    "B11 A13",
    f"WITH {SRC}, n AS (SELECT source_file, count(*) AS n, sum(CASE WHEN k % 200 >= 100 THEN 1 ELSE 0 END) AS p FROM src GROUP BY 1) SELECT source_file, unnest(['handlers', 'routes', 'params', 'constraints', 'config_accesses', 'sinks', 'auth_hints', 'state_hints', 'references', 'strings']) AS bucket, CAST(unnest([3 * n, 3 * n, 2 * n, 3 * n, n, 2 * n, 2 * n, n, n, 6 * n + p]) AS BIGINT) AS matches FROM n",
)
def src_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each bucket in each file, before deduplication."""
    return backend.file_counts(corpora.backend_sources(spark, sf_dir)).select("source_file", "bucket", F.col("matches").cast("long").alias("matches"))


@query("A13 D7", f"WITH {SRC} SELECT * FROM (SELECT 'handlers' AS bucket, count(*) AS facts FROM (SELECT DISTINCT source_file, k % 90, 1 AS t FROM src UNION ALL SELECT DISTINCT source_file, k % 60, 2 FROM src UNION ALL SELECT DISTINCT source_file, k % 30, 3 FROM src) UNION ALL SELECT 'sinks', 2 * count(DISTINCT source_file) FROM src UNION ALL SELECT 'references', count(*) FROM (SELECT DISTINCT source_file, k % 40 FROM src))")
def src_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of some buckets, after deduplication."""
    sources = corpora.backend_sources(spark, sf_dir)
    return fuse.bucket_counts({name: backend.facts(sources, name) for name in ("handlers", "sinks", "references")})


# --- server configuration -----------------------------------------------------------------------------------------------


CFG = "c AS (SELECT s_suppkey AS k, s_suppkey // 20 AS bundle_id FROM supplier)"


def config_query(name: str, operators: str, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = serverconfig.TABLES[name](corpora.config_sources(spark, sf_dir))
        return found.select("bundle_id", *columns, *([F.size("evidence").cast("long").alias("pieces")] if "evidence" in found.columns else []))

    run.__doc__ = f"Fact table {name} of configuration text derived from suppliers, with the number of pieces of evidence."
    run.__name__ = f"cfg_{name}"
    query(operators, f"WITH {CFG} {sql}")(run)


config_query("servers", "C1 A8 Q35", ["type", "confidence"], "SELECT bundle_id, t.type, 'medium' AS confidence, count(*) * max(t.n) AS pieces FROM c, (VALUES ('boa', 3), ('nginx', 1), ('lighttpd', 1)) t(type, n) GROUP BY bundle_id, t.type")
config_query("listeners", "C2 T18 T19 A9", ["address", "port", "protocol"], "SELECT bundle_id, CAST(NULL AS VARCHAR) AS address, CAST(port AS INTEGER) AS port, 'http' AS protocol, count(*) AS pieces FROM (SELECT bundle_id, 8000 + k % 100 AS port FROM c UNION ALL SELECT bundle_id, 9000 + k % 3 FROM c) GROUP BY bundle_id, port")
config_query("document_roots", "C3", ["root_type", "path"], "SELECT bundle_id, 'document_root' AS root_type, '/www/' || (k % 10) AS path, count(*) AS pieces FROM c GROUP BY ALL")
config_query("aliases", "C4 N6 J10 Q13", ["url_prefix", "filesystem_path", "mapping_type"], "SELECT bundle_id, url_prefix, filesystem_path, 'alias' AS mapping_type, count(*) AS pieces FROM (SELECT bundle_id, '/img' || (k % 8) || '/' AS url_prefix, '/srv/img' || (k % 8) || '/' AS filesystem_path FROM c UNION ALL SELECT bundle_id, NULL, '/img' || (k % 8) || '/ /srv/img' || (k % 8) || '/' FROM c UNION ALL SELECT bundle_id, '/loc' || (k % 7) || '/', '/srv/loc' || (k % 7) || '/' FROM c) GROUP BY ALL")
config_query("cgi_mappings", "C5 Q14", ["mapping_type", "url_prefix", "filesystem_path", "handler", "extension"], "SELECT bundle_id, t.m AS mapping_type, '/cgi-bin/' AS url_prefix, '/www/cgi' || (k % 6) || '/' AS filesystem_path, CAST(NULL AS VARCHAR) AS handler, CAST(NULL AS VARCHAR) AS extension, count(*) AS pieces FROM c, (VALUES ('script_alias'), ('cgi_bin')) t(m) GROUP BY ALL")
config_query("auth_rules", "C6", ["rule_type", "value"], "SELECT bundle_id, 'password_file' AS rule_type, '/etc/passwd' || (k % 4) AS value, count(*) AS pieces FROM c GROUP BY ALL")
config_query("startup_commands", "C7 V29 V30", ["command", "config_path", "document_root", "port"], "SELECT bundle_id, 'lighttpd' AS command, '/etc/l' || (k % 5) || '.conf' AS config_path, CAST(NULL AS VARCHAR) AS document_root, CAST(9000 + k % 3 AS VARCHAR) AS port, count(*) AS pieces FROM c GROUP BY ALL")
config_query("config_references", "C8", ["reference_type", "path"], "SELECT bundle_id, reference_type, path, count(*) AS pieces FROM (SELECT bundle_id, 'include' AS reference_type, '/etc/extra' || (k % 9) || '.conf' AS path FROM c UNION ALL SELECT bundle_id, 'command_option', '/etc/l' || (k % 5) || '.conf' FROM c) GROUP BY ALL")
config_query("routes", "C9 O11", ["route", "route_type"], "SELECT bundle_id, route, route_type, sum(n)::BIGINT AS pieces FROM (SELECT bundle_id, '/img' || (k % 8) || '/' AS route, 'alias' AS route_type, 1 AS n FROM c UNION ALL SELECT bundle_id, '/loc' || (k % 7) || '/', 'alias', 1 FROM c UNION ALL SELECT bundle_id, '/cgi-bin/', 'cgi_mapping', 2 FROM c) GROUP BY bundle_id, route, route_type")
config_query("references", "C10", ["reference_type", "path"], "SELECT DISTINCT bundle_id, reference_type, path FROM (SELECT bundle_id, 'document_root' AS reference_type, '/www/' || (k % 10) AS path FROM c UNION ALL SELECT bundle_id, 'include', '/etc/extra' || (k % 9) || '.conf' FROM c UNION ALL SELECT bundle_id, 'command_option', '/etc/l' || (k % 5) || '.conf' FROM c)")


@query("A14", f"WITH {CFG} SELECT bundle_id, 'boa|lighttpd|nginx' AS server_types, CAST(count(DISTINCT 8000 + k % 100) + count(DISTINCT k % 3) AS BIGINT) AS listeners, count(DISTINCT k % 10) AS document_roots, count(DISTINCT k % 4) AS auth_rules FROM c GROUP BY bundle_id")
def cfg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each configuration bundle."""
    return serverconfig.summary(corpora.config_sources(spark, sf_dir)).select("bundle_id", "server_types", "listeners", "document_roots", "auth_rules")


def fact_counts_sql(twins: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{bucket}' AS bucket, count(*) AS facts FROM ({ORACLE[twin]})" for bucket, twin in twins.items())


@query("A10", fact_counts_sql({name: f"cfg_{name}" for name in serverconfig.TABLES}))
def cfg_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each family over all configuration bundles, fused for each bundle."""
    return fuse.bucket_counts(serverconfig.facts(corpora.config_sources(spark, sf_dir)))


# --- pages with forms and scripts ------------------------------------------------------------------------------------------


PG = "p AS (SELECT c_custkey AS k, 'http://h' || (c_custkey % 10) || '.example/p' || c_custkey || '.html' AS source_file FROM customer)"
ACTION = "'/apply' || (k % 15) || '.cgi?next=n' || (k % 5)"


@query(
    "H1 H9 X1 X3 X11 X16 A1 Q8",
    f"""WITH {PG}, r AS (SELECT source_file, k, {ACTION} AS url, 'POST' AS method, 'html_form_parser' AS source, 'high' AS confidence FROM p UNION ALL SELECT source_file, k, {ACTION}, 'GET', 'regex_route_miner', 'medium' FROM p UNION ALL SELECT source_file, k, '/status' || (k % 12) || '.asp', 'GET', 'html_link_parser|regex_route_miner', 'medium' FROM p
UNION ALL SELECT source_file, k, '/api/v' || (k % 6), 'PUT', 'js_api_parser', 'high' FROM p UNION ALL SELECT source_file, k, '/api/v' || (k % 6), 'GET', 'regex_route_miner', 'medium' FROM p UNION ALL SELECT source_file, k, '/do' || (k % 4) || '.cgi', 'POST', 'js_api_parser', 'high' FROM p UNION ALL SELECT source_file, k, '/do' || (k % 4) || '.cgi', 'GET', 'regex_route_miner', 'medium' FROM p)
SELECT source_file, url, method, source, confidence, 'T' || (k % 20) AS ui_context FROM r""",
)
def form_page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of pages derived from customers."""
    return frontend.routes(corpora.form_pages(spark, sf_dir)).select("source_file", "url", "method", "source", "confidence", "ui_context")


@query(
    "H2 H7 X12 X13 X14 X17 X19 X20 A2 A21",
    f"""WITH {PG}, r AS (SELECT source_file, 'next' AS name, 'query' AS location, {ACTION} AS route, 'string' AS inferred_type, 'n' || (k % 5) AS "default", 'high' AS confidence, '' AS options FROM p
UNION ALL SELECT source_file, 'wan_ip' || (k % 9), 'body', {ACTION}, 'ipv4_or_host', 'v' || (k % 11), 'high', '' FROM p UNION ALL SELECT source_file, 'csrf_token', 'body', {ACTION}, 'string', 'x', 'high', '' FROM p UNION ALL SELECT source_file, 'mode', 'body', {ACTION}, 'enum', NULL, 'high', 'dhcp|st' || (k % 3) FROM p
UNION ALL SELECT source_file, t.n, 'body', '/api/v' || (k % 6), 'string', NULL, 'high', '' FROM p, (VALUES ('alpha'), ('beta')) t(n) UNION ALL SELECT source_file, t.n, 'body', '/do' || (k % 4) || '.cgi', 'string', NULL, 'medium', '' FROM p, (VALUES ('user'), ('pass')) t(n) UNION ALL SELECT source_file, 'lan' || (k % 5), 'template', NULL, 'string', NULL, 'low', '' FROM p)
SELECT * FROM r""",
)
def form_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of pages derived from customers."""
    found = frontend.params(corpora.form_pages(spark, sf_dir))
    return found.select("source_file", "name", "location", "route", "inferred_type", "default", "confidence", F.array_join("options", "|").alias("options"))


@query("H3 H4 H5 A3", f"WITH {PG} SELECT source_file, 'wan_ip' || (k % 9) AS param, 'max_length' AS kind, CAST(k % 20 + 1 AS VARCHAR) AS value FROM p UNION ALL SELECT source_file, 'wan_ip' || (k % 9), 'required', 'true' FROM p UNION ALL SELECT source_file, 'csrf_token', 'security_token', 'hidden_input' FROM p UNION ALL SELECT source_file, 'mode', 'enum', 'dhcp|st' || (k % 3) FROM p")
def form_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of form fields of pages derived from customers."""
    return frontend.constraints(corpora.form_pages(spark, sf_dir)).select("source_file", "param", "kind", "value")


@query("H5 H6 A4 F16", f"WITH {PG} SELECT source_file, kind, value, source FROM (SELECT source_file, 'csrf' AS kind, 'csrf_token' AS value, 'input:csrf_token' AS source FROM p UNION ALL SELECT source_file, 'csrf', 'csrf_token', 'param:csrf_token' FROM p)")
def page_auth_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints at authentication in pages derived from customers."""
    return frontend.hints(corpora.form_pages(spark, sf_dir), V.AUTH_WORDS).select("source_file", "kind", "value", "source")


@query("H6 H8 H10 V5", "SELECT o_orderkey AS source_file, CASE o_orderkey % 3 WHEN 0 THEN 'reboot' WHEN 1 THEN 'save' ELSE 'upgrade' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'a:/reboot.asp' WHEN 1 THEN 'button text:Save all' ELSE '<meta content=''0; url=/upgrade''>' END AS source FROM orders")
def page_state_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints at state changes in links, captions and meta tags derived from orders."""
    text = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN '<a href="/reboot.asp">x</a>' WHEN 1 THEN '<button>Save all</button>' ELSE '<meta content="0; url=/upgrade">' END""")
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("source_file"), text.alias("content"))
    return frontend.hints(rows, V.STATE_WORDS).select(F.col("source_file").cast("long").alias("source_file"), "kind", "source")


@query("X17 X18 A5 V8", f"WITH {PG} SELECT source_file, 'lan' || (k % 5) AS name, 'nvram_get' AS function, 'medium' AS confidence FROM p UNION ALL SELECT source_file, '<% nvram_get(\"lan' || (k % 5) || '\") %>', 'template_expression', 'low' FROM p")
def template_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template variables of pages derived from customers."""
    return frontend.template_vars(corpora.form_pages(spark, sf_dir)).select("source_file", "name", "function", "confidence")


@query("A7", fact_counts_sql({"routes": "form_page_routes", "params": "form_params", "constraints": "form_constraints", "auth_hints": "page_auth_hints", "template_vars": "template_vars"}))
def page_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each family over all pages derived from customers, fused for each page. The pages are parsed once."""
    ensure_checkpoints(spark)
    sources = corpora.form_pages(spark, sf_dir)
    return fuse.bucket_counts(frontend.facts(sources, frontend.html_events(sources).checkpoint()))


@query("X1 X2 X4 X5 X9 X10 Q7 F19", "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'ajax' WHEN 2 THEN 'axios_verb' WHEN 3 THEN 'axios' ELSE 'fetch' END AS kind, '/u' || (o_orderkey % 90) AS url, CASE o_orderkey % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'PATCH' ELSE 'GET' END AS method FROM orders UNION ALL SELECT o_orderkey, 'object', '/u' || (o_orderkey % 90), 'GET' FROM orders WHERE o_orderkey % 5 IN (1, 3)")
def js_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in script lines derived from orders."""
    text = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN 'x.open("put", "/u' || (o_orderkey % 90) || '")' WHEN 1 THEN '$.ajax({url: "/u' || (o_orderkey % 90) || '", type: "POST"})' WHEN 2 THEN 'axios.delete("/u' || (o_orderkey % 90) || '")' WHEN 3 THEN 'axios({method: "patch", url: "/u' || (o_orderkey % 90) || '"})' ELSE 'fetch("/u' || (o_orderkey % 90) || '")' END""")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_file"), text.alias("content"))
    return frontend.script_calls(rows).select(F.col("source_file").alias("k"), "kind", "url", "method")


@query("X6 X7 X8 X15", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'query' ELSE 'inline' END AS kind, 'n' || (o_orderkey % 70) AS name FROM orders UNION ALL SELECT o_orderkey, 'body', 'n' || (o_orderkey % 70) FROM orders WHERE o_orderkey % 3 < 2")
def js_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended fields and inline addresses in script lines derived from orders."""
    text = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN 'new FormData(f).append("n' || (o_orderkey % 70) || '", 1)' WHEN 1 THEN 'URLSearchParams(q).append("n' || (o_orderkey % 70) || '", 1)' ELSE 'location.href = "n' || (o_orderkey % 70) || '"' END""")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("content"))
    appended = rules.matches(rows, "content", frontend.APPENDS, ["name"]).select("k", "kind", "name")
    return appended.unionByName(rules.matches(rows, "content", frontend.INLINE, ["url"]).select("k", F.lit("inline").alias("kind"), F.col("url").alias("name")))


@query(
    "W3 W4 W5 W6 W9 A19 Q27 Q29",
    f"""WITH {PG} SELECT source_file AS url, 'f' || (k % 15) AS form_id, 'http://h' || (k % 10) || '.example' || {ACTION} AS action, 'POST' AS method, TRUE AS risky, 'csrf_token=x' AS seeds FROM p""",
)
def seed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request templates of pages derived from customers, with the values that are safe to repeat."""
    rows = crawl.seed_templates(corpora.form_pages(spark, sf_dir).select("url", "html"))
    seeds = F.array_join(F.transform(F.array_sort(F.map_entries("seed_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return rows.select(F.col("source_page").alias("url"), "form_id", F.col("target").alias("action"), "method", "risky", seeds.alias("seeds"))


@query("W7 A18", f"WITH {PG}, e AS (SELECT 'POST' AS method, '/apply' || (k % 15) || '.cgi' AS path, source_file FROM p) SELECT method, path, count(DISTINCT source_file) AS urls, TRUE AS risky FROM e GROUP BY method, path UNION ALL SELECT 'GET', '/p' || k || '.html', 1, NULL FROM p")
def form_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of pages derived from customers."""
    rows = crawl.endpoints(corpora.form_pages(spark, sf_dir).select("url", "html"))
    return rows.select("method", "path", F.size("source_urls").cast("long").alias("urls"), "risky")


# --- binary contexts ------------------------------------------------------------------------------------------------------


BIN = """f AS (SELECT l_suppkey AS doc_id, l_partkey AS p, l_orderkey * 8 + l_linenumber AS a, l_linenumber AS n, '0x' || lower(hex(l_orderkey * 8 + l_linenumber)) AS addr, CASE l_partkey % 4 WHEN 0 THEN 'apply_cgi_' || l_partkey WHEN 1 THEN 'do_login' || l_partkey ELSE 'sub_' || l_partkey END AS name FROM lineitem)"""


def contexts_query(operators: str, sql: str) -> Callable[[Query], Query]:
    return query(operators, f"WITH {BIN} {sql}")


@contexts_query("P4 V24", "SELECT DISTINCT doc_id, name, addr, a AS size FROM f WHERE p % 4 < 2")
def bin_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose names say that they handle requests."""
    return binary.handlers(corpora.contexts(spark, sf_dir)).select("doc_id", "name", "addr", "size")


@contexts_query("P1 P2 A12", "SELECT DISTINCT doc_id, '/page' || (p % 35) || '.asp' AS value FROM f WHERE p % 5 = 0")
def bin_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route strings of contexts derived from line items."""
    return binary.tagged(corpora.contexts(spark, sf_dir), "route").select("doc_id", "value")


@contexts_query("P2", "SELECT DISTINCT doc_id, CASE p % 5 WHEN 1 THEN 'login failed.' ELSE 'HTTP_COOKIE' END AS value FROM f WHERE p % 5 IN (1, 2)")
def bin_auth_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that speak of authentication."""
    return binary.tagged(corpora.contexts(spark, sf_dir), "auth").select("doc_id", "value")


@contexts_query("P3 Q34", "SELECT DISTINCT doc_id, CASE p % 5 WHEN 0 THEN '/page' || (p % 35) || '.asp' ELSE 'HTTP_COOKIE' END AS value FROM f WHERE p % 5 IN (0, 2)")
def bin_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that name paths, pages or request variables."""
    return binary.string_references(corpora.contexts(spark, sf_dir)).select("doc_id", "value")


@contexts_query(
    "P9 P12 J1 J2 V25 V26",
    """, x AS (SELECT doc_id, '/page' || (p % 35) || '.asp' AS route, name AS handler, addr AS handler_addr, CASE WHEN p % 4 < 2 THEN 'high' ELSE 'medium' END AS confidence FROM f WHERE p % 5 = 0
UNION ALL SELECT g.doc_id, 'r' || (g.p % 40), 'sub_' || g.p, coalesce(h.addr, g.addr), 'high' FROM f g LEFT JOIN (SELECT doc_id, name, arg_max(addr, a) AS addr FROM f GROUP BY doc_id, name) h ON h.doc_id = g.doc_id AND h.name = 'sub_' || g.p WHERE g.n % 3 = 2) SELECT DISTINCT doc_id, route, handler, handler_addr, confidence FROM x""",
)
def bin_route_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and the functions that serve them, by references and by registrations."""
    return binary.route_mappings(corpora.contexts(spark, sf_dir)).select("doc_id", "route", "handler", "handler_addr", "confidence")


@contexts_query("P6 P10 P15 Q24 Q33", """SELECT DISTINCT doc_id, name AS function, 'getenv' AS reader_api, 'getenv' AS name, 'env' AS param_source FROM f WHERE n % 4 = 1 UNION ALL SELECT DISTINCT doc_id, name, 'websGetVar', 'p' || (p % 50), 'unknown' FROM f WHERE n % 3 = 0""")
def bin_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that functions read."""
    return binary.params(corpora.contexts(spark, sf_dir)).select("doc_id", "function", "reader_api", "name", "param_source")


@contexts_query("P7 P11 T16 V15", """SELECT DISTINCT doc_id, name AS function, 'nvram_get' AS api, CAST(NULL AS VARCHAR) AS key, 'read' AS access_type FROM f WHERE n % 4 = 2 UNION ALL SELECT DISTINCT doc_id, name, 'nvram_set', 'k' || (p % 30), 'write' FROM f WHERE n % 3 = 1""")
def bin_config_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that functions read and write."""
    return binary.config_accesses(corpora.contexts(spark, sf_dir)).select("doc_id", "function", "api", "key", "access_type")


@contexts_query("P8 J7 V17 Q26", "SELECT DISTINCT doc_id, 'system' AS api, 'command' AS category, name AS function, addr AS function_addr FROM f WHERE n % 4 = 0")
def bin_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of interfaces with side effects."""
    return binary.sinks(corpora.contexts(spark, sf_dir)).select("doc_id", "api", "category", "function", "function_addr")


@contexts_query("P13 P14", "SELECT DISTINCT doc_id, name AS function, 'numeric_boundary' AS kind, 'x' AS target, '<' AS operator, CAST(p % 9 AS VARCHAR) AS value FROM f WHERE n % 3 = 1")
def bin_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in the text of functions."""
    return binary.constraints(corpora.contexts(spark, sf_dir)).select("doc_id", "function", "kind", "target", "operator", "value")


@contexts_query("P16 J3 A20 Q23", "SELECT DISTINCT doc_id, name, addr, CAST(1 AS INTEGER) AS callee_count FROM f JOIN (SELECT DISTINCT doc_id, addr FROM f WHERE p % 5 <> 4 OR n % 4 <> 3 OR p % 4 < 2) USING (doc_id, addr)")
def bin_candidate_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that use a tagged string or a known interface, or are handlers."""
    return binary.candidate_functions(corpora.contexts(spark, sf_dir)).select("doc_id", "name", "addr", "callee_count").distinct()


@contexts_query("P5 V28 N4", """SELECT DISTINCT doc_id, name AS function, addr AS function_addr, CASE n % 3 WHEN 0 THEN 'v = websGetVar(wp, "p' || (p % 50) || '", "d");' ELSE 'nvram_set("k' || (p % 30) || '", v); if (x < ' || (p % 9) || ') return;' END AS snippet FROM f WHERE n % 3 < 2""")
def bin_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling lines of functions."""
    return binary.snippets(corpora.contexts(spark, sf_dir)).distinct()


@contexts_query(
    "A15",
    """SELECT doc_id, count(DISTINCT CASE WHEN p % 5 IN (1, 2) THEN p % 5 END) AS auth, CAST(0 AS BIGINT) AS state, count(DISTINCT CASE WHEN p % 5 = 1 THEN 1 END) AS response,
count(DISTINCT CASE WHEN p % 5 = 0 THEN p % 35 WHEN p % 5 = 2 THEN -1 END) AS references, count(DISTINCT CASE WHEN p % 5 < 4 THEN p END) AS strings FROM f GROUP BY doc_id""",
)
def bin_hint_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of each context by category, with its references and telling strings."""
    categories = F.col("hint_categories")
    return binary.summary(corpora.contexts(spark, sf_dir)).select("doc_id", *(F.try_element_at(categories, F.lit(c)).alias(c) for c in ("auth", "state", "response")), "references", "strings")


@contexts_query(
    "A16 D8",
    """SELECT doc_id, count(DISTINCT n) AS imports, count(*) FILTER (p % 4 = 0) AS exports, count(*) AS names, count(DISTINCT p) AS strings, count(*) AS functions, count(DISTINCT (addr, p % 7)) AS callgraph_edges FROM f GROUP BY doc_id""",
)
def bin_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables of an exported context hold, before any fact is drawn from them."""
    return binary.stage_counts(corpora.context_tables(spark, sf_dir))


@contexts_query("O7", "SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT DISTINCT doc_id, p FROM f)) WHERE r <= 50 AND p % 5 < 4")
def bin_first_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling strings among the first fifty of each context; the limit is the feature."""
    return binary.strings_of(corpora.contexts(spark, sf_dir), 50).select("doc_id", F.substring("addr", 2, 20).cast("long").alias("p"))


@contexts_query("A15", "SELECT doc_id, count(DISTINCT CASE WHEN p % 5 = 0 THEN p % 35 END) AS routes, count(DISTINCT CASE WHEN n % 4 = 0 THEN (name, addr) END) AS sinks FROM f GROUP BY doc_id")
def bin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each context."""
    return binary.summary(corpora.contexts(spark, sf_dir)).select("doc_id", "routes", "sinks")


@query(
    "J5",
    "WITH s AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS addr FROM lineitem WHERE l_quantity > 25) SELECT l_orderkey, l_linenumber, l_suppkey AS doc_id, l_partkey AS target, addr IS NOT NULL AS is_string FROM lineitem LEFT JOIN s ON doc_id = l_suppkey AND addr = l_partkey",
)
def data_reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of line items to parts, as strings where the supplier has the part as one, else as named data."""
    items = table(spark, sf_dir, "lineitem")
    strings = items.where("l_quantity > 25").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("addr"))
    return binary.data_references(items.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("target")), strings)


EDGES = "e AS (SELECT l_suppkey AS doc_id, l_partkey AS caller_addr, l_orderkey % 1000 AS callee_addr FROM lineitem)"


@query("P17 J6", f"WITH {EDGES} SELECT doc_id, caller_addr, callee_addr FROM e WHERE caller_addr % 9 = 0 OR callee_addr % 9 = 0")
def callgraph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of which either end is a candidate."""
    edges = corpora.call_graph(spark, sf_dir)
    ends = edges.select("doc_id", F.col("caller_addr").alias("addr")).union(edges.select("doc_id", "callee_addr")).where("addr % 9 = 0").distinct()
    return binary.candidate_edges(edges, ends).select("doc_id", "caller_addr", "callee_addr")


@query("P18 N4", f"WITH {EDGES}, d AS (SELECT DISTINCT * FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, caller_addr ORDER BY callee_addr) AS n FROM d) SELECT doc_id, caller_addr, callee_addr FROM r WHERE n <= 32")
def callgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls, at most 32 of a function."""
    return binary.call_edges(corpora.call_graph(spark, sf_dir))


@query("P19 A20", f"WITH {EDGES}, i AS (SELECT doc_id, callee_addr AS addr, count(*) AS callers FROM e GROUP BY ALL), o AS (SELECT doc_id, caller_addr AS addr, count(DISTINCT callee_addr) AS callees FROM e GROUP BY ALL) SELECT doc_id, addr, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM i FULL JOIN o USING (doc_id, addr)")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites and called functions of every function."""
    edges = corpora.call_graph(spark, sf_dir)
    return binary.call_counts(edges, 16 * edges.rdd.getNumPartitions())  # files are split by size, so parts grow with them


@query("P20 J8", "WITH w AS (SELECT DISTINCT 'sym' || (s_suppkey % 200) AS symbol FROM supplier), n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' END || 'sym' || p_partkey AS name, p_partkey AS pos FROM part) SELECT symbol, arg_min(name, (name <> symbol, pos)) AS name FROM w JOIN n ON ends_with(n.name, w.symbol) GROUP BY symbol")
def symbol_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and the names that equal them or end in them."""
    wanted = table(spark, sf_dir, "supplier").selectExpr("'sym' || (s_suppkey % 200) AS symbol")
    names = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' END || 'sym' || p_partkey AS name", "p_partkey AS pos")
    return binary.resolved_symbols(wanted, names)


@query("J11", "WITH f AS (SELECT p_partkey AS name, p_partkey * 100 AS start, p_partkey * 100 + p_size AS stop FROM part WHERE p_size > 0) SELECT o_orderkey AS ea_key, f.name FROM orders JOIN f ON CAST(o_totalprice AS BIGINT) >= start AND CAST(o_totalprice AS BIGINT) < stop")
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses derived from order prices and the functions, derived from parts, that contain them."""
    functions = table(spark, sf_dir, "part").where("p_size > 0").selectExpr("0 AS doc_id", "p_partkey AS name", "p_partkey * 100 AS start", "p_partkey * 100 + p_size AS stop")
    addresses = table(spark, sf_dir, "orders").selectExpr("0 AS doc_id", "o_orderkey AS ea_key", "CAST(rint(o_totalprice) AS BIGINT) AS ea")
    return binary.functions_at(addresses, functions).select("ea_key", "name")


@query("T22 O3", "SELECT l_orderkey, l_linenumber, '0x' || lower(hex(l_orderkey * 8 + l_linenumber)) AS addr, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS number FROM lineitem")
def address_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal addresses and their numbers."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_orderkey") * 8 + F.col("l_linenumber")))).alias("addr"))
    return rows.withColumn("number", C.address_number(F.col("addr")).cast("long"))


# --- inputs, outputs and runs -----------------------------------------------------------------------------------------------


@query("A17 D15 F20", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS non_ok FROM orders")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of a run whose inputs are orders; finished ones are ok."""
    return bundles.status_summary(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")))


@query(
    "S12 S13 S14 S15 F4 V33 O1",
    """SELECT 'd/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.bin' WHEN 1 THEN '.so' ELSE '' END AS relative_path, CASE p_partkey % 6 WHEN 0 THEN 'elf' WHEN 1 THEN 'elf' WHEN 2 THEN 'macho' END AS kind, CAST(CASE p_partkey % 6 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 64 END AS INTEGER) AS bits FROM part WHERE p_partkey % 6 <> 4""",
)
def binary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files, derived from parts, are binaries, and of which kind."""
    header = F.expr("unhex(CASE p_partkey % 6 WHEN 0 THEN '7F454C4601000000' WHEN 1 THEN '7F454C4602000000' WHEN 2 THEN 'CFFAEDFE00000000' WHEN 3 THEN '4142004100000000' WHEN 4 THEN '4142434445464748' ELSE '4100420000000000' END)")
    path = F.expr("'d/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.bin' WHEN 1 THEN '.so' ELSE '' END")
    files = table(spark, sf_dir, "part").select(path.alias("relative_path"), F.col("p_size").cast("long").alias("size"), header.alias("header"))
    return bundles.binary_candidates(files).select("relative_path", "kind", "bits")


@query("A6 N4 G1", "WITH r AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag || l_linestatus || (l_partkey % 40) AS e FROM lineitem), d AS (SELECT l_suppkey, e, min((l_shipdate, l_orderkey, l_linenumber)) AS s FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s) AS k FROM d) SELECT l_suppkey, string_agg(e, ',' ORDER BY k) AS evidence FROM n WHERE k <= 10 GROUP BY l_suppkey")
def evidence_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pieces of evidence of each supplier, in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"), F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 40).cast("string")).alias("evidence"))
    return fuse.merge_evidence(rows, ["l_suppkey"], cap=10, bounded=True).select("l_suppkey", F.array_join("evidence", ",").alias("evidence"))


@query("N3 A11 A12", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM r WHERE n = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line item of every part and supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"))
    return fuse.first_wins(rows, ["l_partkey", "l_suppkey"])


@query(
    "J15",
    f"""WITH {CFG}, a AS (SELECT DISTINCT '/loc' || (k % 7) || '/' AS prefix, '/srv/loc' || (k % 7) || '/' AS target FROM c), u AS (SELECT o_orderkey, '/loc' || (o_orderkey % 9) || '/p' || (o_orderkey % 50) || '.cgi' AS url FROM orders)
SELECT o_orderkey, url, target || substr(url, length(prefix) + 1) AS file FROM u LEFT JOIN a ON starts_with(u.url, a.prefix)""",
)
def routes_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses derived from orders, mapped to files by the aliases of a configuration (an extension: the longest prefix wins).

    Prefixes are joined by equality with all prefixes of an address that end in a slash.
    """
    found = serverconfig.aliases(corpora.config_sources(spark, sf_dir)).where("startswith(url_prefix, '/loc')").select(F.col("url_prefix").alias("prefix"), F.col("filesystem_path").alias("target")).distinct()
    urls = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'/loc' || (o_orderkey % 9) || '/p' || (o_orderkey % 50) || '.cgi' AS url")
    parts = F.split("url", "/")
    prefixes = urls.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))))
    best = prefixes.join(found, "prefix").groupBy("o_orderkey").agg(F.max_by(F.concat("target", F.expr("substr(url, length(prefix) + 1)")), F.length("prefix")).alias("file"))
    return urls.join(best, "o_orderkey", "left").select("o_orderkey", "url", "file")


@query("extension: tumbling windows", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; the same function runs on a stream."""
    return arrivals.windowed_counts(table(spark, sf_dir, "events"))


@query(
    "extension: sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS events FROM s GROUP BY user_id, n""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users; the same function runs on a stream."""
    return arrivals.sessions(table(spark, sf_dir, "events"))
