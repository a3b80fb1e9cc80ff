"""Facts of exported binary contexts: strings, handlers, route mappings, params, config accesses, sinks, constraints, candidates.

A context is one nested JSON document; it is exploded once into child tables, and only the columns in use are read. Names of
interfaces are dimension tables of fixed size, so they may be broadcast; everything else is joined by document and address.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V
from factweave.operators.fuse import capped, first_wins
from factweave.operators.rules import Rule, matches
from factweave.session import stored

CONTEXT = """
binary string,
imports array<struct<module:string,name:string,ordinal:bigint,addr:string>>,
exports array<struct<index:bigint,ordinal:bigint,addr:string,name:string>>,
names array<struct<addr:string,name:string>>,
strings array<struct<addr:string,value:string,xrefs:array<struct<xref_addr:string,function_addr:string,function_name:string,snippet:string>>>>,
functions array<struct<addr:string,name:string,size:bigint,callers:array<struct<function_addr:string,callsite:string>>,callees:array<struct<function_addr:string,callsite:string>>,
  string_refs:array<struct<string_addr:string,xref_addr:string,snippet:string>>,import_refs:array<struct<name:string,module:string,xref_addr:string,snippet:string>>,disassembly:array<struct<addr:string,text:string>>,pseudocode:string>>,
callgraph_edges array<struct<caller:string,caller_addr:string,callee:string,callee_addr:string,callsite:string>>
"""

# The patterns that define these facts.
NAME = r"[A-Za-z_]\w*"
PARAM_CALLS = [Rule("call", r"\b(websGetVar2?|cgiFormString|cgiFormInteger|cgiFormDouble|get_cgi|getVar|get_single|GetValue|getenv)\s*\(([^;\n]+)\)", {"api": 1, "args": 2})]
CONFIG_CALLS = [Rule("call", r"\b(nvram_(?:get|safe_get|set|unset|commit|default_get)|uci_(?:get|set|commit)|apmib_(?:get|set)|mib_(?:get|set)|config_(?:get|set))\s*\(([^;\n]+)\)", {"api": 1, "args": 2})]
REGISTER_CALLS = [Rule("call", r"\b(websFormDefine|websUrlHandlerDefine|cgi_register|ejRegister|asp_register)\s*\(([^;\n]+)\)", {"api": 1, "args": 2})]
CONSTRAINTS = [
    Rule("int_cast", rf"\b(atoi|atol|strtol|strtoul)\s*\(\s*({NAME})", {"api": 1, "target": 2}),
    Rule("strlen_compare", rf"\bstrlen\s*\(\s*({NAME})\s*\)\s*([<>!=]=?)\s*(\d+)", {"target": 1, "operator": 2, "value": 3}),
    Rule("string_enum", rf'\b(strcmp|strncmp|strcasecmp|strncasecmp)\s*\(\s*({NAME})\s*,\s*"([^"]+)"', {"api": 1, "target": 2, "value": 3}),
    Rule("format_scan", rf'\bsscanf\s*\(\s*({NAME})\s*,\s*"([^"]+)"', {"target": 1, "value": 2}),
    Rule("ip_format", rf"\b(inet_addr|inet_aton)\s*\(\s*({NAME})", {"api": 1, "target": 2}),
    Rule("numeric_boundary", rf"\bif\s*\(\s*({NAME})\s*([<>]=?|==|!=)\s*(-?\d+)\s*\)", {"target": 1, "operator": 2, "value": 3}),
]
HANDLER_NAME = r"(?i)(?:^|_)(?:cgi|asp|ej|hnap|login|logout|apply|upgrade|reboot|handler)(?:_|$)|do_(?:login|apply|upgrade|reboot|auth)"
ROUTE_NAME = r"(?i)(cgi|asp|handler|login|logout|apply|upgrade|reboot|hnap)"


class Listed(NamedTuple):
    """Contexts taken apart: a row for each function, as functions_of() gives them, and for each string, as all_strings() does."""

    functions: DataFrame
    strings: DataFrame


def listed(contexts: DataFrame) -> Listed:
    """What strings, references, uses, handlers, routes and candidates are drawn from, written a row each.

    A context of many functions is a row of megabytes, of which Spark reads thousands at once; rows of its parts stay small.
    """
    functions = functions_of(contexts).select("doc_id", "pos", "addr", "name", "size", "callers", "callees", "string_refs", "import_refs", "text")
    return Listed(stored(functions), stored(all_strings(contexts)))


def functions_of(contexts: DataFrame | Listed) -> DataFrame:
    """A row for each function: doc_id, pos, addr, name, size, its references, and text (pseudocode, else the disassembly)."""
    if isinstance(contexts, Listed):
        return contexts.functions
    rows = contexts.select("doc_id", F.posexplode("functions").alias("pos", "f"))
    listing = F.array_join(F.transform("f.disassembly", lambda d: F.coalesce(d["text"], F.lit(""))), "\n")
    text = F.coalesce(F.nullif("f.pseudocode", F.lit("")), listing, F.lit(""))
    return rows.select("doc_id", "pos", "f.addr", "f.name", "f.size", "f.callers", "f.callees", "f.string_refs", "f.import_refs", "f.disassembly", "f.pseudocode", text.alias("text"))


def all_strings(contexts: DataFrame | Listed, max_strings: int | None = None) -> DataFrame:
    """doc_id, pos, addr, value and xrefs of every string; of the first max_strings of a context, if given."""
    if isinstance(contexts, Listed):
        return contexts.strings if max_strings is None else contexts.strings.where(F.col("pos") < max_strings)
    found = F.col("strings") if max_strings is None else F.slice("strings", 1, max_strings)
    return contexts.select("doc_id", F.posexplode(found).alias("pos", "s")).select("doc_id", "pos", "s.addr", "s.value", "s.xrefs")


def strings_of(contexts: DataFrame | Listed, max_strings: int | None = None) -> DataFrame:
    """all_strings() that have a tag, with their tags."""
    rows = all_strings(contexts, max_strings)
    return rows.withColumn("tags", C.string_tags(F.coalesce("value", F.lit("")))).where(F.size("tags") > 0)


def tagged(contexts: DataFrame, tag: str) -> DataFrame:
    """doc_id, value, addr of strings with a tag; each value once."""
    rows = strings_of(contexts).where(F.array_contains("tags", tag)).select("doc_id", "value", "addr", F.col("pos").alias("seq"))
    return first_wins(rows, ["doc_id", "value"])


def string_references(contexts: DataFrame) -> DataFrame:
    rows = strings_of(contexts).where(C.is_reference(F.col("value"))).select("doc_id", "value", "addr", F.lit("string").alias("reference_type"), F.col("pos").alias("seq"))
    return first_wins(rows, ["doc_id", "value", "reference_type"])


def handlers(contexts: DataFrame | Listed) -> DataFrame:
    """doc_id, name, addr, size of functions whose names say that they handle requests."""
    rows = functions_of(contexts).where(F.col("name").rlike(HANDLER_NAME)).select("doc_id", "name", "addr", "size", F.lit("function_name").alias("source"), F.col("pos").alias("seq"))
    return first_wins(rows, ["doc_id", "name", "addr"])


def snippets(contexts: DataFrame, limit: int = 20) -> DataFrame:
    """doc_id, function, function_addr and the first telling lines of its disassembly and pseudocode."""
    telling = lambda x: C.any_word(x, V.SNIPPET_TOKENS)
    code = F.transform(F.filter(C.lines_of(F.coalesce("pseudocode", F.lit(""))), telling), C.strip)
    found = F.concat(F.filter(F.transform(F.coalesce("disassembly", F.array().cast("array<struct<addr:string,text:string>>")), lambda d: d["text"]), telling), code)
    rows = functions_of(contexts).withColumn("lines", found).where(F.size("lines") > 0)
    return rows.select("doc_id", F.col("name").alias("function"), F.col("addr").alias("function_addr"), F.array_join(F.slice("lines", 1, limit), "\n").alias("snippet"))


def api_dimension(spark: SparkSession) -> DataFrame:
    """api (in lower case for sinks), use and category: three fixed lists."""
    rows = [(a, "param", "param") for a in V.PARAM_READERS] + [(a, "config", "config") for a in V.CONFIG_APIS] + [(a, "sink", c) for c, names in V.SINKS.items() for a in names]
    return spark.createDataFrame(rows, "api string, use string, category string")


def import_uses(contexts: DataFrame | Listed) -> DataFrame:
    """doc_id, use, category, api, function, function_addr, xref_addr, snippet, seq: references to known interfaces."""
    refs = functions_of(contexts).select("doc_id", "pos", F.col("name").alias("function"), F.col("addr").alias("function_addr"), F.posexplode("import_refs").alias("ref_no", "r"))
    refs = refs.select("*", F.col("r.name").alias("api"), "r.xref_addr", "r.snippet", F.struct("pos", "ref_no").alias("seq")).drop("r")
    known = F.broadcast(api_dimension(refs.sparkSession).withColumnRenamed("api", "known"))
    return refs.join(known, F.when(F.col("use") == "sink", F.lower("api")).otherwise(F.col("api")) == F.col("known")).drop("known", "pos", "ref_no")


def _calls(contexts: DataFrame | Listed, rules: list[Rule]) -> DataFrame:
    rows = functions_of(contexts).select("doc_id", "pos", F.col("name").alias("function"), F.col("addr").alias("function_addr"), "text")
    found = matches(rows, "text", rules, ["api", "args"]).drop("text")
    return found.withColumn("literals", C.c_strings(F.col("args"))).withColumn("seq", F.struct("pos", "match_no"))


def params(contexts: DataFrame) -> DataFrame:
    """doc_id, function, reader_api, name: parameters read, first from imports, then from text; one row for each of the three."""
    used = import_uses(contexts).where("use = 'param'").select("doc_id", "function", F.col("api").alias("reader_api"), F.col("api").alias("name"), "function_addr", F.lit(None).cast("string").alias("default"), C.binary_param_source(F.col("api"), F.lit(""), F.coalesce("snippet", F.lit(""))).alias("param_source"), F.lit("import_ref").alias("source"), F.struct(F.lit(0).alias("s"), "seq.*").alias("seq"))
    read = _calls(contexts, PARAM_CALLS).where(F.size("literals") > 0)
    read = read.select("doc_id", "function", F.col("api").alias("reader_api"), F.get("literals", F.lit(0)).alias("name"), "function_addr", F.get("literals", F.lit(1)).alias("default"), C.binary_param_source(F.col("api"), F.get("literals", F.lit(0)), F.col("matched")).alias("param_source"), F.lit("function_text").alias("source"), F.struct(F.lit(1).alias("s"), F.col("pos"), F.col("match_no").alias("ref_no")).alias("seq"))
    return first_wins(used.unionByName(read), ["doc_id", "function", "reader_api", "name"])


def config_accesses(contexts: DataFrame) -> DataFrame:
    used = import_uses(contexts).where("use = 'config'").select("doc_id", "function", "api", F.lit(None).cast("string").alias("key"), "function_addr", F.lit("import_ref").alias("source"), F.struct(F.lit(0).alias("s"), "seq.*").alias("seq"))
    read = _calls(contexts, CONFIG_CALLS).select("doc_id", "function", "api", F.get("literals", F.lit(0)).alias("key"), "function_addr", F.lit("function_text").alias("source"), F.struct(F.lit(1).alias("s"), F.col("pos"), F.col("match_no").alias("ref_no")).alias("seq"))
    return first_wins(used.unionByName(read), ["doc_id", "function", "api", "key"]).withColumn("access_type", C.binary_access(F.col("api")))


def sinks(contexts: DataFrame) -> DataFrame:
    rows = import_uses(contexts).where("use = 'sink'").select("doc_id", "api", "category", "function", "function_addr", "xref_addr", "snippet", "seq")
    return first_wins(rows, ["doc_id", "api", "function", "function_addr", "xref_addr"])


def route_mappings(contexts: DataFrame | Listed) -> DataFrame:
    """doc_id, route, handler, handler_addr: functions that refer to a route string, and registrations in their text."""
    rows = functions_of(contexts)
    refs = rows.select("doc_id", "pos", "name", "addr", F.posexplode("string_refs").alias("ref_no", "r")).withColumn("string_addr", F.col("r.string_addr"))
    # of several strings at one address the last counts
    whole = all_strings(contexts).groupBy("doc_id", F.col("addr").alias("string_addr")).agg(F.max_by("value", "pos").alias("value"))
    used = refs.join(whole, ["doc_id", "string_addr"]).where(F.array_contains(C.string_tags(F.col("value")), "route"))
    used = used.select("doc_id", F.col("value").alias("route"), F.col("name").alias("handler"), F.col("addr").alias("handler_addr"), F.lit(None).cast("string").alias("registration_api"), F.lit("string_xref").alias("source"), F.when(F.col("name").rlike(ROUTE_NAME), "high").otherwise("medium").alias("confidence"), F.struct("pos", F.lit(0).alias("part"), F.col("ref_no").alias("no")).alias("seq"))
    made = _calls(contexts, REGISTER_CALLS).withColumn("route", F.get("literals", F.lit(0))).where("route IS NOT NULL AND route <> ''")
    made = made.withColumn("handler", F.coalesce(F.nullif(F.regexp_extract("args", r"(?U),\s*([A-Za-z_]\w+)\s*\)?", 1), F.lit("")), F.col("function")))
    by_name = rows.groupBy("doc_id", F.col("name").alias("handler")).agg(F.max_by("addr", "pos").alias("own_addr"))
    made = made.join(by_name, ["doc_id", "handler"], "left")
    made = made.select("doc_id", "route", "handler", F.coalesce("own_addr", "function_addr").alias("handler_addr"), F.col("api").alias("registration_api"), F.lit("function_text").alias("source"), F.lit("high").alias("confidence"), F.struct("pos", F.lit(1).alias("part"), F.col("match_no").alias("no")).alias("seq"))
    return first_wins(used.unionByName(made), ["doc_id", "route", "handler", "handler_addr"])


def constraints(contexts: DataFrame) -> DataFrame:
    rows = functions_of(contexts).select("doc_id", "pos", F.col("name").alias("function"), F.col("addr").alias("function_addr"), "text")
    found = matches(rows, "text", CONSTRAINTS, ["api", "target", "operator", "value"])
    found = found.select("doc_id", "function", "kind", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("value", "api", F.lit("")).alias("value"), "operator", "function_addr", F.struct("pos", "rule_no", "match_no").alias("seq"))
    return first_wins(found, ["doc_id", "function", "kind", "target", "value"])


def candidates(contexts: DataFrame | Listed) -> DataFrame:
    """doc_id and addr of functions that use a tagged string, a known interface, or a handler's name."""
    used = strings_of(contexts).select("doc_id", F.explode("xrefs").alias("x")).select("doc_id", F.col("x.function_addr").alias("addr")).where("addr IS NOT NULL AND addr <> ''")
    return used.unionAll(import_uses(contexts).select("doc_id", F.col("function_addr"))).unionAll(handlers(contexts).select("doc_id", "addr")).distinct()


def first_candidates(contexts: DataFrame, limit: int) -> DataFrame:
    """The first `limit` candidates of each context by the number of their address; the limit is the feature."""
    return capped(candidates(contexts).withColumn("at", C.address_number(F.col("addr"))), ["doc_id"], limit, ["at", "addr"]).drop("at")


def candidate_functions(contexts: DataFrame | Listed) -> DataFrame:
    rows = functions_of(contexts).select("doc_id", "name", "addr", "size", F.greatest(F.size("callers"), F.lit(0)).alias("caller_count"), F.greatest(F.size("callees"), F.lit(0)).alias("callee_count"))
    return rows.join(candidates(contexts), ["doc_id", "addr"])


def candidate_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of which either end is a candidate; two equality joins, so no nested loop. edges: doc_id, caller_addr, callee_addr."""
    left = chosen.select("doc_id", F.col("addr").alias("caller_addr")).distinct().withColumn("l", F.lit(True))
    right = chosen.select("doc_id", F.col("addr").alias("callee_addr")).distinct().withColumn("r", F.lit(True))
    return edges.join(left, ["doc_id", "caller_addr"], "left").join(right, ["doc_id", "callee_addr"], "left").where("l OR r").drop("l", "r")


def call_edges(calls: DataFrame, per_function: int = 32, visits: DataFrame | None = None) -> DataFrame:
    """Distinct caller and callee pairs in order of discovery, at most so many for each visit of a caller.

    calls: doc_id, caller_addr, callee_addr and, where the order of a function's calls is known, `site` (else its callees come by
    address). visits: doc_id and addr, a row for each candidate address that lies in the function that starts at addr: a function that is
    taken up again goes on where its cap ended, so n visits keep the first n times as many edges. Without it a function is visited once.
    """
    site = F.col("site") if "site" in calls.columns else F.col("callee_addr")
    pairs = calls.groupBy("doc_id", "caller_addr", "callee_addr").agg(F.min(site).alias("site"))
    out = pairs.columns if "site" in calls.columns else pairs.columns[:-1]
    if visits is None:
        return capped(pairs, ["doc_id", "caller_addr"], per_function, ["site", "callee_addr"]).select(out)
    times = visits.groupBy("doc_id", F.col("addr").alias("caller_addr")).agg(F.count("*").alias("visits_"))
    met = pairs.join(times, ["doc_id", "caller_addr"])
    once = capped(met.where("visits_ = 1"), ["doc_id", "caller_addr"], per_function, ["site", "callee_addr"])
    again = met.where("visits_ > 1").withColumn("rank_", F.row_number().over(Window.partitionBy("doc_id", "caller_addr").orderBy("site", "callee_addr")))
    return once.select(out).unionByName(again.where(F.col("rank_") <= per_function * F.col("visits_")).select(out))


def call_counts(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, addr, callers (call sites) and callees (distinct functions).

    Both ends of a call are rows of one shuffle by function, so no task holds more groups than its part of the rows. parts: how many
    there are, for callers who know the size of their edges; else Spark chooses.
    """
    ends = edges.select("doc_id", F.explode(F.array(F.struct(F.col("callee_addr").alias("addr"), F.lit(None).cast(edges.schema["callee_addr"].dataType).alias("callee"), F.lit(True).alias("called")), F.struct(F.col("caller_addr").alias("addr"), F.col("callee_addr").alias("callee"), F.lit(False).alias("called")))).alias("e")).select("doc_id", "e.*")
    dealt = ends.repartition("doc_id", "addr") if parts is None else ends.repartition(parts, "doc_id", "addr")
    pairs = dealt.groupBy("doc_id", "addr", "callee", "called").agg(F.count("*").alias("n"))
    apart = F.when(F.col("addr").isNull(), F.col("called")).alias("apart")  # ends without an address are not one function
    return pairs.groupBy("doc_id", "addr", apart).agg(F.sum(F.when(F.col("called"), F.col("n")).otherwise(0)).alias("callers"), F.count(F.when(~F.col("called"), F.col("callee"))).alias("callees")).drop("apart")


def resolved_symbols(wanted: DataFrame, names: DataFrame, shortest: int = 3) -> DataFrame:
    """symbol and name: the equal name, else the first (by pos) that ends in the symbol. names: name, pos.

    Names are listed by their endings, so the join is one of equality.
    """
    endings = names.withColumn("symbol", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - shortest + 1, F.lit(1))), lambda i: F.substring("name", i, F.length("name")))))
    best = wanted.select("symbol").distinct().join(endings, "symbol").groupBy("symbol").agg(F.min_by("name", F.struct((F.col("name") != F.col("symbol")).alias("other"), "pos", "name")).alias("name"))
    return best


#: Cells of level k are 4^k addresses wide.
CELL_BITS, ADDRESS_BITS = 2, 64
TOP = ADDRESS_BITS // CELL_BITS - 1


def cells_of(functions: DataFrame) -> DataFrame:
    """The ranges with level and cell: aligned cells that lie in a range, do not overlap, and together make it up; of each level six at most.

    At each level a range keeps what its whole cells of the next level leave at its two ends.
    """
    bits = f"{CELL_BITS} * level"
    down = lambda x, by: f"shiftright({x}, CAST({by} AS INT))"
    up = lambda x, by: f"({down(x, by)} + IF(shiftleft({down(x, by)}, CAST({by} AS INT)) < {x}, 1, 0))"
    rows = functions.where("start < stop").withColumn("level", F.expr(f"explode(sequence(0, least({TOP}, CAST(length(bin(try_subtract(stop, start))) DIV {CELL_BITS} AS INT))))"))
    rows = rows.withColumns({"lo_": F.expr(up("start", bits)), "hi_": F.expr(down("stop", bits))}).where("lo_ < hi_")
    rows = rows.withColumns({"in_": F.expr(f"IF(level = {TOP}, hi_, {up('start', f'least({ADDRESS_BITS - CELL_BITS}, {bits} + {CELL_BITS})')})"), "out_": F.expr(f"IF(level = {TOP}, hi_, {down('stop', f'least({ADDRESS_BITS - CELL_BITS}, {bits} + {CELL_BITS})')})")})
    rows = rows.withColumns({"in_": F.expr(f"IF(level = {TOP} OR in_ >= out_, hi_, in_ * {1 << CELL_BITS})"), "out_": F.expr(f"IF(level = {TOP} OR in_ >= out_, hi_, out_ * {1 << CELL_BITS})")})
    return rows.withColumn("cell", F.expr("explode(concat(filter(transform(sequence(0, 5), i -> try_add(lo_, i)), c -> c < in_), filter(transform(sequence(-3, -1), i -> try_add(hi_, i)), c -> c >= out_)))")).drop("lo_", "hi_", "in_", "out_")


def _levels(cells: DataFrame, addresses: DataFrame) -> DataFrame:
    """A row for each address and each level that cells have, with the address's cell there. The driver gets the levels, 32 at most."""
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    return addresses.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell", F.expr(f"shiftright(ea, CAST({CELL_BITS} * level AS INT))"))


def functions_at(addresses: DataFrame, functions: DataFrame) -> DataFrame:
    """Each address with every function that contains it (start <= ea < stop).

    addresses: doc_id, ea; functions: doc_id, name, start, stop. An address lies in one cell of a range that holds it and in none of any
    other, so the rows that meet are those that are returned, whatever the ranges' lengths. Cells are many more than the functions, by
    whose size Spark would broadcast them, so both sides are shuffled.
    """
    cells = cells_of(functions)
    return _levels(cells, addresses).join(cells.hint("merge"), ["doc_id", "level", "cell"]).drop("level", "cell")


def totals_at(addresses: DataFrame, functions: DataFrame, sums: dict[str, Column], least: dict[str, Column]) -> DataFrame:
    """Each address that a function contains, with sums and smallest values over all functions that contain it; no pairs are made.

    addresses: doc_id, ea and more; functions: doc_id, start, stop and what the columns read. Each cell is summed up once, and each
    different address takes up its one cell of each level. Neither cells nor totals pass the driver.
    """
    cells = cells_of(functions)
    of_cell = cells.groupBy("doc_id", "level", "cell").agg(*(F.sum(c).alias(k) for k, c in sums.items()), *(F.min(c).alias(k) for k, c in least.items()))
    points = _levels(cells, addresses.select("doc_id", "ea").distinct())
    found = points.join(of_cell.hint("merge"), ["doc_id", "level", "cell"]).groupBy("doc_id", "ea").agg(*(F.sum(k).alias(k) for k in sums), *(F.min(k).alias(k) for k in least))
    return addresses.join(found.hint("merge"), ["doc_id", "ea"])


def data_references(references: DataFrame, strings: DataFrame) -> DataFrame:
    """The references with `is_string`: whether the target is the address of one of the context's strings; else it is named data.

    references: doc_id, target and more; strings: doc_id, addr. Strings are told apart before they are joined, so none adds rows.
    """
    known = strings.select("doc_id", F.col("addr").alias("target"), F.lit(True).alias("known")).distinct()
    return references.join(known, ["doc_id", "target"], "left").withColumn("is_string", F.coalesce("known", F.lit(False))).drop("known")


def segments_of(contexts: DataFrame) -> DataFrame:
    """doc_id, pos, name, start, end, size and perm of the segments that `binary`, a JSON object, names."""
    rows = contexts.select("doc_id", F.from_json("binary", "segments array<struct<name:string,start:string,end:string,size:bigint,perm:bigint>>")["segments"].alias("all"))
    return rows.select("doc_id", F.posexplode("all").alias("pos", "s")).select("doc_id", "pos", "s.*")


def imports_of(contexts: DataFrame) -> DataFrame:
    """doc_id, pos, module, name, ordinal and addr of the imports table; an import without a name is called by its ordinal."""
    rows = contexts.select("doc_id", F.posexplode("imports").alias("pos", "i")).select("doc_id", "pos", "i.*")
    return rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("ord_"), F.col("ordinal").cast("string"))))


def exports_of(contexts: DataFrame) -> DataFrame:
    return contexts.select("doc_id", F.explode("exports").alias("e")).select("doc_id", "e.*")


def stage_counts(contexts: DataFrame) -> DataFrame:
    """doc_id and how many imports, exports, names, strings, functions and call-graph edges a context's tables hold."""
    tables = {"imports": "imports", "exports": "exports", "names": "names", "strings": "strings", "functions": "functions", "callgraph_edges": "callgraph_edges"}
    return contexts.select("doc_id", *(F.greatest(F.size(column), F.lit(0)).cast("long").alias(name) for name, column in tables.items()))


def summary(contexts: DataFrame) -> DataFrame:
    """doc_id, the number of facts of each table, and hint_categories: the hints and responses by category. Contexts are taken apart
    into functions and strings, which are written; strings, references and texts of functions are searched once for all tables that they
    fill. A fact is told by the keys of its table, so all but candidate functions are counted as different rows."""
    contexts = listed(contexts)
    tables = ["routes", "auth_hints", "state_hints", "response_strings", "strings", "handlers", "route_mappings", "params", "config_accesses", "sinks", "constraints", "references", "functions"]
    nothing = F.lit(None).cast("string")
    fact = lambda table, *keys: F.struct(F.lit(table).alias("table"), *(k.cast("string").alias(f"k{n}") for n, k in enumerate([*keys, *[nothing] * 4][:4])))
    c = F.col
    tags = {"route": "routes", "auth": "auth_hints", "state": "state_hints", "response": "response_strings"}
    of_string = [F.when(F.array_contains("tags", tag), fact(table, c("value"))) for tag, table in tags.items()] + [fact("strings", c("addr")), F.when(C.is_reference(c("value")), fact("references", c("value")))]
    texts = functions_of(contexts).select("doc_id", c("name").alias("function"), "text")
    found = matches(texts, "text", PARAM_CALLS + CONFIG_CALLS + CONSTRAINTS, ["api", "args", "target", "operator", "value"]).withColumn("literals", C.c_strings(c("args")))
    key, config_at, constraint_at = F.get("literals", F.lit(0)), len(PARAM_CALLS), len(PARAM_CALLS) + len(CONFIG_CALLS)
    of_match = (
        F.when(c("rule_no") >= constraint_at, fact("constraints", c("function"), c("kind"), F.coalesce("target", F.lit("")), F.coalesce("value", "api", F.lit(""))))
        .when(c("rule_no") >= config_at, fact("config_accesses", c("function"), c("api"), key))
        .when(F.size("literals") > 0, fact("params", c("function"), c("api"), key))
    )
    of_use = F.when(c("use") == "param", fact("params", c("function"), c("api"), c("api"))).when(c("use") == "config", fact("config_accesses", c("function"), c("api"), nothing)).otherwise(fact("sinks", c("api"), c("function"), c("function_addr"), c("xref_addr")))
    facts = strings_of(contexts).select("doc_id", F.explode(F.array_compact(F.array(*of_string))).alias("f"))
    facts = facts.unionAll(found.select("doc_id", of_match.alias("f")).where("f IS NOT NULL")).unionAll(import_uses(contexts).select("doc_id", of_use))
    facts = facts.unionAll(handlers(contexts).select("doc_id", fact("handlers", c("name"), c("addr")))).unionAll(route_mappings(contexts).select("doc_id", fact("route_mappings", c("route"), c("handler"), c("handler_addr"))))
    rows = facts.select("doc_id", "f.*").distinct().select("doc_id", "table").unionAll(candidate_functions(contexts).select("doc_id", F.lit("functions")))
    counts = rows.groupBy("doc_id").pivot("table", tables).agg(F.count(F.lit(1))).na.fill(0)
    return counts.withColumn("hint_categories", F.create_map(F.lit("auth"), F.col("auth_hints"), F.lit("state"), F.col("state_hints"), F.lit("response"), F.col("response_strings")))
