"""Facts of backend source text, line by line: handlers, routes, params, constraints, config accesses, sinks, hints, includes, strings.

Every function takes sources (source_file, content) and returns its table before deduplication, with `seq` for first_wins().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators.fuse import first_wins
from factweave.operators.rules import Rule, every_match, first_match, matches, source_lines

# The patterns that define these facts.
NAME = r"[A-Za-z_]\w*"
HANDLERS = [
    Rule("registration", rf'\bwebsFormDefine\s*\(\s*"([^"]+)"\s*,\s*({NAME})', {"route": 1, "handler": 2}),
    Rule("registration", rf'\bwebsUrlHandlerDefine\s*\(\s*"([^"]+)"[^,]*,\s*({NAME})', {"route": 1, "handler": 2}),
    Rule("registration", rf'\bcgi_register\s*\(\s*"([^"]+)"\s*,\s*({NAME})', {"route": 1, "handler": 2}),
    Rule("registration", rf'\bregister_handler\s*\(\s*"([^"]+)"\s*,\s*({NAME})', {"route": 1, "handler": 2}),
    Rule("dispatch_table", rf'\{{\s*"([^"]+)"\s*,\s*({NAME})\s*\}}', {"route": 1, "handler": 2}),
    Rule("handler_symbol", rf"\b(?:int|void|char\s*\*)\s+({NAME}(?:_cgi|_handler|_asp|_form|_apply|_submit))\s*\(", {"handler": 1}),
]
ROUTES = [
    Rule("url_literal", r'"(/(?:goform|cgi-bin|api|hnap1|HNAP1)[^"]*)"', {"route": 1}),
    Rule("cgi_asp_stm_literal", r'"([^"]+\.(?:cgi|asp|stm)(?:\?[^"]*)?)"', {"route": 1}),
    Rule("dispatch_key_value", r'"(action|cmd|page|handler|module)"\s*[,=]\s*"([^"]+)"', {"dispatch_key": 1, "route": 2}, nocase=True),
    Rule("location_header", r'"Location:\s*([^"]+)"', {"route": 1}, nocase=True),
]
PARAMS = [
    Rule("websGetVar", r'\b(websGetVar2?|cgiFormString|cgiFormInteger|cgiFormDouble)\s*\(\s*[^,]*,\s*"([^"]+)"(?:\s*,\s*([^)\n]+))?', {"read_api": 1, "param": 2, "default_value": 3}),
    Rule("common_getter", r'\b(get_cgi|getVar|get_single|GetValue)\s*\(\s*"([^"]+)"(?:\s*,\s*([^)\n]+))?', {"read_api": 1, "param": 2, "default_value": 3}),
    Rule("getenv", r'\b(getenv)\s*\(\s*"(QUERY_STRING|CONTENT_LENGTH|HTTP_COOKIE|REQUEST_METHOD|HTTP_[A-Z_]+)"\s*\)', {"read_api": 1, "param": 2}),
    Rule("custom_getter", r'\b([A-Za-z_]\w*(?:get|cgi|param|query|form|cookie|header)[A-Za-z_]\w*)\s*\(\s*"([A-Za-z0-9_.:-]+)"', {"read_api": 1, "param": 2}, nocase=True),
]
CONSTRAINTS = [
    Rule("int_cast", rf"\b(atoi|atol|strtol|strtoul)\s*\(\s*({NAME})", {"api": 1, "target": 2}),
    Rule("strlen_compare", rf"\bstrlen\s*\(\s*({NAME})\s*\)\s*([<>!=]=?)\s*(\d+)", {"target": 1, "operator": 2, "value": 3}),
    Rule("string_enum", rf'\b(strcmp|strncmp|strcasecmp|strncasecmp)\s*\(\s*({NAME})\s*,\s*"([^"]+)"(?:\s*,\s*(\d+))?', {"api": 1, "target": 2, "value": 3, "extra": 4}),
    Rule("format_scan", rf'\bsscanf\s*\(\s*({NAME})\s*,\s*"([^"]+)"', {"target": 1, "value": 2}),
    Rule("ip_format", rf"\b(inet_addr|inet_aton)\s*\(\s*({NAME})", {"api": 1, "target": 2}),
    Rule("null_or_empty", rf"\bif\s*\(\s*(!\s*{NAME}|{NAME}\s*==\s*NULL|{NAME}\s*!=\s*NULL)\s*\)", {"extra": 1}),
    Rule("numeric_boundary", rf"\bif\s*\(\s*({NAME})\s*([<>]=?|==|!=)\s*(-?\d+)\s*\)", {"target": 1, "operator": 2, "value": 3}),
]
CONFIG = [Rule("config_api", r"\b(nvram_(?:get|safe_get|set|unset|commit)|uci_(?:get|set|commit)|config_(?:get|set)|apmib_(?:get|set)|mib_(?:get|set))\s*\(([^)]*)\)", {"api": 1, "raw_args": 2})]
SINKS = [
    Rule("command", r"\b(system|popen|execl|execv|execve|execvp|spawnl|spawnlp)\s*\(", {"api": 1}),
    Rule("file", r"\b(fopen|open|unlink|remove|rename|chmod|chown)\s*\(", {"api": 1}),
    Rule("memory", r"\b(strcpy|strncpy|strcat|strncat|sprintf|snprintf|vsprintf|memcpy|memmove|gets)\s*\(", {"api": 1}),
    Rule("network", r"\b(socket|connect|send|recv)\s*\(", {"api": 1}),
    Rule("config_state", r"\b(nvram_commit|uci_commit|config_set|apmib_set|mib_set)\s*\(", {"api": 1}),
    Rule("state", r"\b(reboot|restart|reset|restore|upgrade|flash_write|apply)\w*\s*\(", {"api": 1}),
]
AUTH = [Rule("auth_keyword", r"\b(login|logout|auth|admin|privilege|permission|password|passwd|pwd|session|sid|cookie|token|csrf|nonce|check_login|is_admin|auth_check)\b", {"keyword": 1}, nocase=True)]
STATE = [Rule("state_keyword", r"\b(apply|save|commit|reboot|restart|reset|restore|upgrade)\b", {"keyword": 1}, nocase=True)]
INCLUDES = [Rule("include", r'^\s*#\s*include\s+[<"]([^>"]+)[>"]', {"value": 1})]
STRINGS = [Rule("string_literal", C.C_STRING, {"string": 1})]


def _facts(sources: DataFrame, rules: list[Rule], fields: list[str], *, every: bool) -> DataFrame:
    found = matches(source_lines(sources), "line", rules, fields, every=every)
    return found.withColumn("seq", F.struct("line_no", "rule_no", "match_no")).withColumn("snippet", C.snippet(F.col("line")))


def _with_place(facts: DataFrame, *columns: str | Column) -> DataFrame:
    return facts.select("source_file", *columns, F.col("line_no").alias("line"), "snippet", "seq")


def handlers(sources: DataFrame) -> DataFrame:
    found = _facts(sources, HANDLERS, ["route", "handler"], every=False)
    return _with_place(found.where("handler IS NOT NULL"), "handler", "kind")


def route_mappings(sources: DataFrame) -> DataFrame:
    found = _facts(sources, HANDLERS, ["route", "handler"], every=False)
    return _with_place(found.where("route IS NOT NULL"), "route", "handler")


def routes(sources: DataFrame) -> DataFrame:
    """Routes of registrations (kind handler_linked) and of literals; the former come first on a line."""
    linked = _facts(sources, HANDLERS, ["route", "handler"], every=False).where("route IS NOT NULL").withColumn("kind", F.lit("handler_linked")).withColumn("dispatch_key", F.lit(None).cast("string"))
    literal = _facts(sources, ROUTES, ["route", "dispatch_key"], every=True).where("route IS NOT NULL").withColumn("rule_no", F.col("rule_no") + len(HANDLERS))
    columns = ["route", "kind", "dispatch_key"]
    both = linked.select("source_file", *columns, "line_no", "rule_no", "match_no", "snippet").unionByName(literal.select("source_file", *columns, "line_no", "rule_no", "match_no", "snippet"))
    return _with_place(both.withColumn("seq", F.struct("line_no", "rule_no", "match_no")), *columns)


def params(sources: DataFrame) -> DataFrame:
    found = _facts(sources, PARAMS, ["read_api", "param", "default_value"], every=True).where("param IS NOT NULL")
    found = found.withColumn("param_source", C.source_param_source(F.col("read_api"), F.col("param"), F.col("line"))).withColumn("default_value", C.strip(F.col("default_value")))
    return _with_place(found, "param", "read_api", "param_source", "default_value")


def constraints(sources: DataFrame) -> DataFrame:
    found = _facts(sources, CONSTRAINTS, ["api", "target", "operator", "value", "extra"], every=True)
    return _with_place(found, F.col("kind").alias("constraint_type"), "api", "target", "operator", "value", "extra")


def config_accesses(sources: DataFrame) -> DataFrame:
    found = _facts(sources, CONFIG, ["api", "raw_args"], every=False).withColumn("raw_args", C.strip(F.coalesce("raw_args", F.lit(""))))
    return _with_place(found, "api", C.source_access(F.col("api")).alias("access_type"), F.get(C.c_strings(F.col("raw_args")), F.lit(0)).alias("config_key"), "raw_args")


def sinks(sources: DataFrame) -> DataFrame:
    return _with_place(_facts(sources, SINKS, ["api"], every=False), F.col("kind").alias("sink_category"), "api")


def auth_hints(sources: DataFrame) -> DataFrame:
    return _with_place(_facts(sources, AUTH, ["keyword"], every=True), "keyword")


def state_hints(sources: DataFrame) -> DataFrame:
    return _with_place(_facts(sources, STATE, ["keyword"], every=True), "keyword")


def references(sources: DataFrame) -> DataFrame:
    return _with_place(_facts(sources, INCLUDES, ["value"], every=False), F.lit("include").alias("reference_type"), "value")


def strings(sources: DataFrame) -> DataFrame:
    found = _facts(sources, STRINGS, ["string"], every=True).where(F.length(C.strip(F.col("string"))) >= 4)
    return _with_place(found, "string", C.string_type(F.col("string")).alias("string_type"))


#: Table -> (extractor, columns that make a fact; source_file is always one of them).
TABLES = {
    "handlers": (handlers, ["handler", "kind"]), "routes": (routes, ["route", "kind", "dispatch_key"]), "route_mappings": (route_mappings, ["route", "handler"]), "params": (params, ["param", "read_api", "param_source", "default_value"]),
    "constraints": (constraints, ["constraint_type", "api", "target", "operator", "value", "extra"]), "config_accesses": (config_accesses, ["api", "access_type", "config_key", "raw_args"]), "sinks": (sinks, ["sink_category", "api"]),
    "auth_hints": (auth_hints, ["keyword", "line", "snippet"]), "state_hints": (state_hints, ["keyword", "line", "snippet"]), "references": (references, ["reference_type", "value"]), "strings": (strings, ["string", "string_type"]),
}


def facts(sources: DataFrame, table: str) -> DataFrame:
    """One fact table, each fact once for a file, with the place where it stood first."""
    extract, keys = TABLES[table]
    return first_wins(extract(sources), ["source_file", *keys])


def file_counts(sources: DataFrame) -> DataFrame:
    """source_file, bucket and matches before deduplication, for every file and bucket that has any. Each line is read once for all."""
    line, low = "line", "low_"
    lines = source_lines(sources).withColumn("low_", F.lower("line"))
    lines = lines.withColumn("linked", first_match(line, HANDLERS, ["route", "handler"], low))
    having = lambda found, field: F.size(F.filter(found, lambda m: m[field].isNotNull()))
    every = lambda rules, *fields: every_match(line, rules, list(fields), low)
    counts = {
        "handlers": having(F.col("linked"), "handler"), "routes": having(F.col("linked"), "route") + having(every(ROUTES, "route"), "route"), "params": having(every(PARAMS, "param"), "param"), "constraints": F.size(every(CONSTRAINTS)),
        "config_accesses": F.size(first_match(line, CONFIG, [], low)), "sinks": F.size(first_match(line, SINKS, [], low)), "auth_hints": F.size(every(AUTH)), "state_hints": F.size(every(STATE)), "references": F.size(first_match(line, INCLUDES, [], low)),
        "strings": F.size(F.filter(every(STRINGS, "string"), lambda m: F.length(C.strip(m["string"])) >= 4)),
    }
    summed = lines.groupBy("source_file").agg(*(F.sum(n).alias(name) for name, n in counts.items()))
    return summed.unpivot("source_file", list(counts), "bucket", "matches").where("matches > 0").select("source_file", "matches", "bucket")
