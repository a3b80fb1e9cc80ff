"""Facts of web-server configuration and startup scripts, line by line.

Sources are (bundle_id, source_file, content); facts are merged over all files of a bundle, with their evidence.
Tokens of command lines come from a small Arrow function, for those lines only that hold quotes or backslashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V
from factweave.operators.fuse import merge_evidence
from factweave.operators.rules import Rule, first_match
from factweave.session import stored

# The patterns that define these facts.
SERVERS = [
    Rule("busybox httpd", r"\bbusybox\s+httpd\b|\bhttpd\s+.*\bbusybox\b", {}, nocase=True),
    Rule("lighttpd", r"\blighttpd\b|server\.document-root|server\.port|cgi\.assign", {}, nocase=True),
    Rule("nginx", r"\bnginx\b|\bserver\s*\{|\blocation\s+/", {}, nocase=True),
    Rule("boa", r"\bboa\b|^\s*(Port|DocumentRoot|ScriptAlias|CGIPath)\b", {}, nocase=True),
    Rule("goahead", r"\bgoahead\b|goahead-webs|webs\.conf", {}, nocase=True),
    Rule("httpd", r"(?<![\w.-])httpd(?![\w.-])|\bmini_httpd\b|\bmicro_httpd\b", {}, nocase=True),
]
LISTENERS = [
    Rule("Port", r"^\s*Port\s+(.+)$", {"value": 1}, nocase=True),
    Rule("Listen", r"^\s*Listen\s+(.+)$", {"value": 1}, nocase=True),
    Rule("listen;", r"^\s*listen\s+(.+?);?\s*$", {"value": 1}, nocase=True),
    Rule("server.port", r"^\s*server\.port\s*=\s*(.+)$", {"value": 1}, nocase=True),
    Rule("PORT=", r"^\s*(?:HTTP_PORT|WEB_PORT|PORT)\s*=\s*(.+)$", {"value": 1}, nocase=True),
]
ROOTS = [
    Rule("document_root", r"^\s*DocumentRoot\s+(.+)$", {"value": 1}, nocase=True),
    Rule("server_root", r"^\s*ServerRoot\s+(.+)$", {"value": 1}, nocase=True),
    Rule("document_root", r"^\s*server\.document-root\s*=\s*(.+)$", {"value": 1}, nocase=True),
    Rule("document_root", r"^\s*root\s+(.+?);?\s*$", {"value": 1}, nocase=True),
    Rule("document_root", r"^\s*(?:WEBROOT|WWWROOT|DOCUMENT_ROOT)\s*=\s*(.+)$", {"value": 1}, nocase=True),
]
ALIASES = [
    Rule("Alias", r"^\s*Alias\s+(\S+)\s+(.+)$", {"prefix": 1, "path": 2}, nocase=True),
    Rule("alias.url", r'^\s*alias\.url\s*\+=\s*\(\s*"([^"]+)"\s*=>\s*"([^"]+)"', {"prefix": 1, "path": 2}, nocase=True),
    Rule("alias;", r"^\s*alias\s+(.+?);?\s*$", {"path": 1}, nocase=True),
]
CGI = [
    Rule("script_alias", r"^\s*ScriptAlias\s+(\S+)\s+(.+)$", {"a": 1, "b": 2}, nocase=True),
    Rule("script_alias_match", r"^\s*ScriptAliasMatch\s+(\S+)\s+(.+)$", {"a": 1, "b": 2}, nocase=True),
    Rule("cgi_path", r"^\s*CGIPath\s+(.+)$", {"a": 1}, nocase=True),
    Rule("add_handler", r"^\s*AddHandler\s+(\S+)\s+(.+)$", {"a": 1, "b": 2}, nocase=True),
    Rule("add_type", r"^\s*AddType\s+(\S+)\s+(.+)$", {"a": 1, "b": 2}, nocase=True),
    Rule("cgi_assign", r'^\s*cgi\.assign\s*=\s*\(\s*"([^"]+)"\s*=>\s*"([^"]*)"', {"a": 1, "b": 2}, nocase=True),
    Rule("fastcgi", r'^\s*fastcgi\.server\s*=\s*\(\s*"([^"]+)"', {"a": 1}, nocase=True),
    Rule("location_cgi", r"^\s*location\s+(/[^ \t{;]*cgi[^ \t{;]*)", {"a": 1}, nocase=True),
    Rule("cgi_bin", r"""(/[^ \t"']*cgi-bin/?)(?:\s+([^ \t"']+))?""", {"a": 1, "b": 2}, nocase=True),
    Rule("cgi_extension", r"(\*\.cgi|\.cgi\b)", {"a": 1}, nocase=True),
]
AUTH = [
    Rule("auth_type", r"^\s*AuthType\s+(.+)$", {"value": 1}, nocase=True),
    Rule("realm", r"^\s*(?:AuthName|realm)\s+(.+)$", {"value": 1}, nocase=True),
    Rule("password_file", r"^\s*(?:AuthUserFile|userfile)\s+(.+)$", {"value": 1}, nocase=True),
    Rule("password_file", r"^\s*auth\.backend\.htpasswd\.userfile\s*=\s*(.+)$", {"value": 1}, nocase=True),
    Rule("auth_require", r"^\s*auth\.require\s*=\s*(.+)$", {"value": 1}, nocase=True),
    Rule("require", r"^\s*Require\s+(.+)$", {"value": 1}, nocase=True),
    Rule("allow", r"^\s*allow\s+(.+)$", {"value": 1}, nocase=True),
    Rule("deny", r"^\s*deny\s+(.+)$", {"value": 1}, nocase=True),
    Rule("satisfy", r"^\s*satisfy\s+(.+)$", {"value": 1}, nocase=True),
    Rule("htpasswd", r"(\S*\.htpasswd\S*)", {"value": 1}, nocase=True),
]
INCLUDES = [
    Rule("include", r"^\s*include(?:_shell)?\s+(.+)$", {"value": 1}, nocase=True),
    Rule("include", r"^\s*IncludeOptional\s+(.+)$", {"value": 1}, nocase=True),
    Rule("source", r"^\s*(?:source|\.)\s+(.+)$", {"value": 1}, nocase=True),
]


def config_lines(sources: DataFrame) -> DataFrame:
    """bundle_id, source_file, line_no, raw and line (without comment) of every line that has something on it."""
    rows = sources.select("bundle_id", "source_file", F.posexplode(C.lines_of(F.coalesce("content", F.lit("")))).alias("line_no", "raw"))
    return rows.withColumn("line_no", F.col("line_no") + 1).withColumn("line", C.without_comment(F.col("raw"))).where("line <> ''")


def _lines(sources: DataFrame, lines: DataFrame | None) -> DataFrame:
    return config_lines(sources) if lines is None else lines


def with_argv(lines: DataFrame) -> DataFrame:
    """`argv`, the shell tokens of each line; unbalanced quotes leave words."""
    return lines.withColumn("argv", C.shell_tokens(F.col("line")))


def _evidence(pattern: Column) -> Column:
    return F.struct("source_file", pattern.alias("pattern"), F.col("line_no").alias("line"), F.substring(C.strip(F.col("raw")), 1, 500).alias("snippet"))


def _matched(lines: DataFrame, rules: list[Rule], fields: list[str]) -> DataFrame:
    return lines.withColumn("m", F.explode(first_match("line", rules, fields))).select(*lines.columns, "m.*").withColumn("seq", F.struct("source_file", "line_no", F.lit(0).alias("part"), "rule_no"))


def _option_rows(lines: DataFrame, option: str, glued: bool) -> DataFrame:
    """value for each token that follows an option or, with `glued`, is written onto it."""
    rows = with_argv(lines.where(F.col("line").contains(option))).select("*", F.posexplode("argv").alias("at", "token"))
    value = F.when(F.col("token") == option, F.get("argv", F.col("at") + 1))
    if glued:
        value = value.when(F.col("token").startswith(option) & (F.length("token") > len(option)), F.substring("token", F.lit(len(option) + 1), F.length("token")))
    rows = rows.withColumn("value", value).where("value IS NOT NULL")
    return rows.withColumn("seq", F.struct("source_file", "line_no", F.lit(1).alias("part"), F.col("at").alias("rule_no"))).withColumn("kind", F.lit(option))


def servers(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The file name counts as line 0, with low confidence; lines have a medium one."""
    names = sources.select("bundle_id", "source_file", F.lit(0).alias("line_no"), C.base_name(F.col("source_file")).alias("raw"), C.base_name(F.col("source_file")).alias("line"))
    lines = names.unionByName(_lines(sources, lines))
    hits = F.array(*(F.when(F.col("line").rlike(r.java), F.struct(F.lit(k).alias("rule_no"), F.lit(r.kind).alias("type"))) for k, r in enumerate(SERVERS)))
    rows = lines.withColumn("m", F.explode(F.array_compact(hits))).select(*lines.columns, "m.*").withColumn("seq", F.struct("source_file", "line_no", "rule_no"))
    rows = rows.withColumn("confidence", F.when(F.col("line_no") == 0, "low").otherwise("medium")).withColumn("evidence", _evidence(F.col("type")))
    return merge_evidence(rows, ["bundle_id", "type"], first=("confidence",))


def listeners(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    lines = _lines(sources, lines)
    rows = _matched(lines, LISTENERS, ["value"]).select(*lines.columns, "kind", "value", "seq").unionByName(_option_rows(lines, "-p", True).select(*lines.columns, "kind", "value", "seq"))
    rows = rows.withColumn("at", C.address_and_port(F.col("value"))).where("at.port IS NOT NULL")
    rows = rows.select("*", C.clean_value(F.col("at.address")).alias("address"), F.col("at.port").alias("port"), F.when(F.col("line").rlike(r"(?iuU)\bssl\b|\bhttps\b"), "https").otherwise("http").alias("protocol")).withColumn("evidence", _evidence(F.col("kind")))
    return merge_evidence(rows, ["bundle_id", "address", "port", "protocol"])


def document_roots(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    lines = _lines(sources, lines)
    rows = _matched(lines, ROOTS, ["value"]).select(*lines.columns, F.col("kind").alias("root_type"), "value", "seq")
    rows = rows.unionByName(_option_rows(lines, "-h", True).select(*lines.columns, F.lit("document_root").alias("root_type"), "value", "seq"))
    return merge_evidence(rows.withColumn("path", C.clean_value(F.col("value"))).withColumn("evidence", _evidence(F.col("root_type"))), ["bundle_id", "root_type", "path"])


def aliases(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """An alias of a location block has the block's prefix; a closing brace ends the block."""
    opened = F.nullif(F.regexp_extract("line", r"(?iuU)^\s*location\s+(\S+)\s*\{?\s*$", 1), F.lit(""))
    event = F.when(F.col("line").contains("}"), F.struct(F.lit(None).cast("string").alias("prefix"))).when(opened.isNotNull(), F.struct(C.clean_value(opened).alias("prefix")))
    order = Window.partitionBy("bundle_id", "source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(sources, lines).withColumn("location", F.last(event, ignorenulls=True).over(order)["prefix"])
    rows = _matched(lines, ALIASES, ["prefix", "path"]).withColumn("url_prefix", F.when(F.col("kind") == "alias;", F.col("location")).otherwise(C.clean_value(F.col("prefix"))))
    rows = rows.withColumn("filesystem_path", C.clean_value(F.col("path"))).withColumn("mapping_type", F.lit("alias")).withColumn("evidence", _evidence(F.col("kind")))
    return merge_evidence(rows, ["bundle_id", "url_prefix", "filesystem_path", "mapping_type"])


def cgi_mappings(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    rows = _matched(_lines(sources, lines), CGI, ["a", "b"]).withColumn("a", C.clean_value(F.col("a"))).withColumn("b", C.clean_value(F.col("b")))
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    named = kind.isin("add_handler", "add_type", "cgi_assign")
    rows = rows.select(
        "bundle_id", kind.alias("mapping_type"), F.when(kind.isin("script_alias", "script_alias_match", "cgi_path", "location_cgi", "cgi_bin", "fastcgi") | named & a.startswith("/"), a).alias("url_prefix"),
        F.when(kind.isin("script_alias", "script_alias_match", "cgi_bin"), b).alias("filesystem_path"), F.when(named, F.coalesce(b, a)).alias("handler"),
        F.when((kind == "cgi_extension") | named & (a.startswith(".") | a.contains("*")), a).alias("extension"), "seq", _evidence(kind).alias("evidence"),
    )
    return merge_evidence(rows, ["bundle_id", "mapping_type", "url_prefix", "filesystem_path", "handler", "extension"])


def auth_rules(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    rows = _matched(_lines(sources, lines), AUTH, ["value"]).withColumn("value", C.clean_value(F.col("value"))).withColumnRenamed("kind", "rule_type").withColumn("path_or_scope", F.lit(None).cast("string"))
    return merge_evidence(rows.withColumn("evidence", _evidence(F.col("rule_type"))), ["bundle_id", "rule_type", "path_or_scope", "value"])


def startup_commands(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    likely = F.lower("line").rlike("busybox|" + "|".join(V.SERVER_COMMANDS))
    rows = with_argv(_lines(sources, lines).where(likely)).withColumn("lower", F.transform("argv", F.lower))
    box = F.array_position("lower", F.lit("busybox"))
    command = F.when((box > 0) & (F.get("lower", box.cast("int")) == "httpd"), "busybox httpd")
    for name in V.SERVER_COMMANDS:
        command = command.when(F.array_contains(F.transform("lower", lambda t: F.element_at(F.split(t, "/"), -1)), name), name)
    rows = rows.withColumn("command", command).where("command IS NOT NULL")
    option = lambda *names: C.option_value(F.col("argv"), list(names))
    rows = rows.select("bundle_id", "command", "argv", option("-c", "-f").alias("config_path"), option("-h").alias("document_root"), option("-p").alias("port"), option("-E").alias("error_log"), option("-r").alias("auth_realm"), F.struct("source_file", "line_no").alias("seq"), _evidence(F.lit("startup_command_token")).alias("evidence"))
    return merge_evidence(rows, ["bundle_id", "command", "config_path", "document_root", "port"], first=("argv", "error_log", "auth_realm"))


def config_references(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    lines = _lines(sources, lines)
    rows = _matched(lines, INCLUDES, ["value"]).select(*lines.columns, F.col("kind").alias("reference_type"), "value", "seq")
    for option in ("-c", "-f"):
        rows = rows.unionByName(_option_rows(lines, option, False).select(*lines.columns, F.lit("command_option").alias("reference_type"), "value", "seq"))
    return merge_evidence(rows.withColumn("path", C.clean_value(F.col("value"))).withColumn("evidence", _evidence(F.col("reference_type"))), ["bundle_id", "reference_type", "path"])


def routes(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Derived: prefixes of aliases, and prefixes or else extensions of CGI mappings."""
    own = aliases(sources, lines).select("bundle_id", F.col("url_prefix").alias("route"), F.lit("alias").alias("route_type"), "evidence")
    cgi = cgi_mappings(sources, lines).select("bundle_id", F.coalesce(F.nullif("url_prefix", F.lit("")), "extension").alias("route"), F.lit("cgi_mapping").alias("route_type"), "evidence")
    rows = own.unionByName(cgi).where("route IS NOT NULL AND route <> ''").withColumn("item", F.explode("evidence"))
    return merge_evidence(rows.select("bundle_id", "route", "route_type", F.struct("item.source_file", "item.line", "item.pattern").alias("seq"), F.col("item").alias("evidence")), ["bundle_id", "route", "route_type"])


def path_references(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Derived: paths of document roots and of configuration references."""
    rows = document_roots(sources, lines).select("bundle_id", "path", F.lit("document_root").alias("reference_type")).unionByName(config_references(sources, lines).select("bundle_id", "path", "reference_type"))
    return rows.where("path IS NOT NULL AND path <> ''").distinct()


TABLES = {"servers": servers, "listeners": listeners, "document_roots": document_roots, "aliases": aliases, "cgi_mappings": cgi_mappings, "auth_rules": auth_rules, "startup_commands": startup_commands, "config_references": config_references, "routes": routes, "references": path_references}


def facts(sources: DataFrame) -> dict[str, DataFrame]:
    """All fact tables of configuration bundles, each fused over the files of its bundle. Lines are split once and written; the tables read them."""
    lines = stored(config_lines(sources))
    return {name: extract(sources, lines) for name, extract in TABLES.items()}


def summary(sources: DataFrame) -> DataFrame:
    """bundle_id, server types and ports, sorted, and the number of each table's facts."""
    found = facts(sources)
    rows = None
    for name, table in found.items():
        kind = F.col("type") if name == "servers" else F.lit(None).cast("string")
        port = F.col("port") if name == "listeners" else F.lit(None).cast("int")
        part = table.select("bundle_id", F.lit(name).alias("table"), kind.alias("type"), port.alias("port"))
        rows = part if rows is None else rows.unionAll(part)
    types = F.array_join(F.sort_array(F.collect_set("type")), "|").alias("server_types")
    ports = F.array_join(F.transform(F.sort_array(F.collect_set("port")), lambda p: p.cast("string")), "|").alias("ports")
    return rows.groupBy("bundle_id").agg(types, ports, *(F.count_if(F.col("table") == name).alias(name) for name in found))
