"""Facts of web pages: routes, params, constraints, hints, interface texts and references from HTML events and scripts.

HTML facts come from the rows of html_events(); script, literal and template facts come from the text by rules. A page's
facts are fused for the page: evidence of one fact is kept in order, at most ten pieces of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V
from factweave.operators.fuse import merge_evidence
from factweave.operators.htmlevents import BARE, html_events
from factweave.operators.rules import Rule, every_match, matches

# The patterns that define these facts.
Q = r"""['"]"""
CALLS = [
    Rule("fetch", rf"fetch\(\s*{Q}([^'\"]+){Q}\s*(?:,\s*(\{{.*?\}}))?\s*\)", {"url": 1, "data": 2}, nocase=True, dotall=True),
    Rule("open", rf"\.open\(\s*{Q}([A-Za-z]+){Q}\s*,\s*{Q}([^'\"]+){Q}", {"verb": 1, "url": 2}, nocase=True),
    Rule("jquery", rf"\$\.(post|get)\(\s*{Q}([^'\"]+){Q}\s*(?:,\s*(\{{.*?\}}|{Q}.*?{Q}))?", {"verb": 1, "url": 2, "data": 3}, nocase=True, dotall=True),
    Rule("ajax", r"\$\.ajax\(\s*(\{.*?\})\s*\)", {"data": 1}, nocase=True, dotall=True),
    Rule("object", rf"{Q}?(?:url|uri|action|endpoint|cgi|submit|post){Q}?\s*:\s*{Q}([^'\"]+){Q}", {"url": 1}, nocase=True),
    Rule("axios_verb", rf"axios\.(get|post|put|delete|patch|head|options)\(\s*{Q}([^'\"]+){Q}\s*(?:,\s*(\{{.*?\}}|{Q}.*?{Q}))?", {"verb": 1, "url": 2, "data": 3}, nocase=True, dotall=True),
    Rule("axios", r"axios\(\s*(\{.*?\})\s*\)", {"data": 1}, nocase=True, dotall=True),
]
APPENDS = [
    Rule("body", rf"FormData\s*\([^)]*\)\.append\(\s*{Q}([^'\"]+){Q}", {"name": 1}, nocase=True),
    Rule("body", rf"\.append\(\s*{Q}([^'\"]+){Q}\s*,", {"name": 1}, nocase=True),
    Rule("query", rf"URLSearchParams\s*\([^)]*\)\.append\(\s*{Q}([^'\"]+){Q}\s*,", {"name": 1}, nocase=True),
]
INLINE = [
    Rule("location", rf"location\.(?:href|assign|replace)\s*(?:=|\()\s*{Q}([^'\"]+){Q}", {"url": 1}, nocase=True),
    Rule("location", rf"(?:window|document)\.location\s*=\s*{Q}([^'\"]+){Q}", {"url": 1}, nocase=True),
    Rule("location", rf"window\.open\(\s*{Q}([^'\"]+){Q}", {"url": 1}, nocase=True),
]
LITERALS = [Rule("literal", r"""(?<q>['"])((?:/[\w./-]+|[\w.-]+\.(?:cgi|asp|php|stm|shtml|htm|html)|\./[\w./-]+|\.\./[\w./-]+)(?:\?[^'"]*)?)\k<q>""", {"url": 2}, nocase=True)]
GETTERS = [Rule("getter", rf"\b(nvram_get|nvram_safe_get|get_single|ej_get|asp_get|getCfg|query|config_get)\s*\(\s*{Q}([^'\"]+){Q}", {"function": 1, "name": 2}, nocase=True)]
EXPRESSIONS = [Rule("expression", r"(<%.*?%>|<\?.*?\?>|<!--#.*?-->|\{\{.*?\}\}|\$\{[^}]+\})", {"name": 1}, dotall=True)]
OBJECT_URL = rf"(?iU){Q}?url{Q}?\s*:\s*{Q}([^'\"]+){Q}"
OBJECT_METHOD = {"fetch": rf"(?iU){Q}?method{Q}?\s*:\s*{Q}([A-Za-z]+){Q}", "ajax": rf"(?iU){Q}?(?:type|method){Q}?\s*:\s*{Q}([A-Za-z]+){Q}", "axios": rf"(?iU){Q}?method{Q}?\s*:\s*{Q}([A-Za-z]+){Q}"}
OBJECT_DATA = rf"(?isU){Q}?(?:data|params|payload|query|postData){Q}?\s*:\s*(\{{.*?\}})"
OBJECT_FIELD = rf"(?U){Q}?([A-Za-z_][\w.-]*){Q}?\s*:"
URLENCODED = r"(?<![A-Za-z0-9_.:-])([A-Za-z_][A-Za-z0-9_.:-]{0,63})="


def attribute(name: str) -> Column:
    """An attribute's value; null if it is absent or has none."""
    return F.nullif(F.try_element_at("attrs", F.lit(name)), F.lit(BARE))


def has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def rendered(tag: Column, names: list[str]) -> Column:
    """A tag with some of its attributes, as evidence."""

    def shown(name: Column) -> Column:
        value = F.try_element_at("attrs", name)
        return F.when(value == BARE, name).when(value.isNotNull(), F.concat(name, F.lit("="), C.quoted(value)))

    own = F.array_compact(F.transform(F.array(*map(F.lit, names)), shown))
    return F.concat(F.lit("<"), F.array_join(F.concat(F.array(tag), own), " "), F.lit(">"))


def _name() -> Column:
    return C.strip(F.coalesce(attribute("name"), F.lit("")))


FIELD_KEYS = ["name", "type", "value", "maxlength", "pattern", "required", "disabled", "readonly"]


def _seq(stage: int, *parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    columns += [F.lit(0)] * (3 - len(columns))
    return F.struct(F.lit(stage).alias("stage"), *(c.cast("int").alias(f"s{k}") for k, c in enumerate(columns)))


def _route_rows(events: DataFrame) -> DataFrame:
    """Routes of forms and links."""
    form, link = F.expr("kind = 'form' AND form_action IS NOT NULL"), F.expr("kind = 'ref' AND tag = 'a' AND text <> '' AND NOT startswith(text, '#')") & C.looks_like_route(F.col("text"))
    pick = lambda of_form, of_link: F.when(F.col("kind") == "form", of_form).otherwise(of_link)
    return events.where(form | link).select(
        "source_file", pick(F.col("form_action"), F.col("text")).alias("url"), pick(C.method_of(F.coalesce(attribute("method"), F.lit(""))), F.lit("GET")).alias("method"),
        pick(F.lit("html_form_parser"), F.lit("html_link_parser")).alias("source"), F.col("title").alias("ui_context"), pick(F.lit("high"), F.lit("medium")).alias("confidence"),
        pick(rendered(F.col("tag"), ["action", "method"]), rendered(F.col("tag"), ["href"])).alias("evidence"), _seq(0, "pos").alias("seq"),
    )


def script_calls(sources: DataFrame) -> DataFrame:
    """kind, url, method, data, matched, rule_no and match_no of every request that script text makes, whether or not the URL counts as a route."""
    rows = matches(sources.select("source_file", "content"), "content", CALLS, ["url", "verb", "data"]).drop("content")
    data = F.coalesce("data", F.lit(""))
    in_object = F.nullif(F.regexp_extract(data, OBJECT_URL, 1), F.lit(""))
    verb = F.when(F.col("kind").isin("open", "jquery", "axios_verb"), F.col("verb"))
    for kind, pattern in OBJECT_METHOD.items():
        verb = verb.when(F.col("kind") == kind, F.regexp_extract(data, pattern, 1))
    url = F.when(F.col("kind").isin("ajax", "axios"), in_object).otherwise(F.col("url"))
    return rows.select("source_file", "kind", url.alias("url"), C.method_of(F.coalesce(verb, F.lit(""))).alias("method"), data.alias("data"), C.collapse(F.col("matched")).alias("evidence"), "rule_no", "match_no").where("url IS NOT NULL")


#: Families of rules over script text, and the fields that their matches have.
FAMILIES = {"call": CALLS, "append": APPENDS, "inline": INLINE, "literal": LITERALS, "getter": GETTERS}
MATCH_FIELDS = ["url", "verb", "data", "name", "function"]


def script_rows(sources: DataFrame, families: list[str]) -> DataFrame:
    """A row for each match of the families' rules, from one pass over each text: source_file, family, kind, url, method, data, name, source,
    confidence, evidence and seq. Requests without an address give none."""

    def tagged(family: str) -> Column:
        found = every_match("content", FAMILIES[family], MATCH_FIELDS, "low")
        return F.transform(found, lambda m: F.struct(F.lit(family).alias("family"), m.alias("m")))

    rows = sources.select("source_file", "content", F.lower("content").alias("low"))
    rows = rows.withColumn("x", F.explode(F.concat(*map(tagged, families)))).select("source_file", "x.family", "x.m.*").withColumn("data", F.coalesce("data", F.lit("")))
    family, kind = F.col("family"), F.col("kind")
    mined = (family == "call") & (kind == "object")
    verb = F.when(kind.isin("open", "jquery", "axios_verb"), F.col("verb"))
    for name, pattern in OBJECT_METHOD.items():
        verb = verb.when(kind == name, F.regexp_extract("data", pattern, 1))
    url = F.when((family == "call") & kind.isin("ajax", "axios"), F.nullif(F.regexp_extract("data", OBJECT_URL, 1), F.lit(""))).otherwise(F.col("url"))
    stage = F.when(family == "call", 2).when(family == "inline", 1).when(family == "literal", 3).when(family == "append", 2).otherwise(4)
    alone = family.isin("literal", "getter")  # families of one rule
    seq = F.struct(stage.alias("stage"), F.when(alone, F.col("match_no")).otherwise(F.col("rule_no")).cast("int").alias("s0"), F.when(alone, 0).otherwise(F.col("match_no")).cast("int").alias("s1"), F.lit(0).alias("s2"))
    rows = rows.withColumn("url", url).where((family != "call") | F.col("url").isNotNull())
    return rows.select(
        "source_file", "family", "kind", "url", F.when(family == "call", C.method_of(F.coalesce(verb, F.lit("")))).otherwise("GET").alias("method"), "data", "name",
        F.when(family == "literal", "regex_route_miner").when(mined, "js_object_route_miner").when(family.isin("append", "getter"), F.when(family == "append", "param_name_miner").otherwise("template_parser")).otherwise("js_api_parser").alias("source"),
        F.when((family == "call") & ~mined, "high").when(family == "getter", "low").otherwise("medium").alias("confidence"),
        F.when(family == "inline", F.concat(F.lit("location/window route reference '"), "url", F.lit("'"))).when(family == "literal", F.col("matched")).otherwise(C.collapse(F.col("matched"))).alias("evidence"), seq.alias("seq"),
    )


def routes(sources: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source_file, url, method, ui_context, source, confidence, evidence: routes fused for each page.

    Pages are parsed once and searched once; the whole title of a page reaches the routes of its scripts within the page's rows.
    """
    events = html_events(sources) if events is None else events
    columns = ["source_file", "url", "method", "source", "ui_context", "confidence", "evidence", "seq"]
    is_title = F.col("kind") == "title"
    of_title = events.where("kind IN ('form', 'ref', 'title')").select("source_file", "kind", "tag", "text", "form_action", "title", "attrs", "pos")
    as_form = {"kind": F.when(is_title, "form").otherwise(F.col("kind")), "form_action": F.when(is_title, TITLE_ROW).otherwise(F.col("form_action")), "title": F.when(is_title, F.col("text")).otherwise(F.col("title"))}
    markup = _route_rows(of_title.withColumns(as_form))
    scripts = script_rows(sources, ["call", "inline", "literal"]).where(C.looks_like_route(F.col("url"))).withColumn("ui_context", F.lit(None).cast("string"))
    both = markup.select(*columns, F.lit(False).alias("script")).unionByName(scripts.select(*columns, F.lit(True).alias("script")))
    title = F.max(F.when(F.col("url") == TITLE_ROW, F.col("ui_context"))).over(Window.partitionBy("source_file"))
    both = both.withColumn("ui_context", F.when(F.col("script"), title).otherwise(F.col("ui_context"))).where(F.col("url") != TITLE_ROW)
    return merge_evidence(both.drop("script"), ["source_file", "url", "method"], known=("ui_context",), sources="source", confidence="confidence", cap=10)


#: Address of the row that carries a page's title; no address holds this character.
TITLE_ROW = "\0title"


def _param(name: Column, location: Column, confidence: Column, evidence: Column, **more: Column) -> Column:
    """A parameter as a struct; what isn't given is null, the type to be told by the name, and the source that of mined names."""
    kinds = {"inferred_type": "string", "default": "string", "required": "boolean", "options": "array<string>", "route": "string", "source": "string"}
    given = {"options": F.array().cast("array<string>"), "source": F.lit("param_name_miner")} | more
    rest = [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return F.struct(name.alias("name"), location.alias("location"), confidence.alias("confidence"), evidence.alias("evidence"), *rest)


def _query_structs(url: Column, confidence: Column, source: str) -> Column:
    """The valid names in the query of an address, as parameters."""
    evidence = F.concat(F.lit("query string in '"), url, F.lit("'"))
    pairs = F.filter(C.query_pairs(url), lambda p: C.is_param_name(p["name"]))
    return F.transform(pairs, lambda p: _param(p["name"], F.lit("query"), confidence, evidence, default=p["value"], route=url, source=F.lit(source)))


def params(sources: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source_file, name, location, route and what is known of each parameter, fused for each page. Pages are parsed and searched once."""
    events = html_events(sources) if events is None else events
    nothing = F.array(_param(*[F.lit("")] * 4))
    none = F.slice(nothing, 1, 0)
    own, in_form, name = F.col("kind"), F.col("form_no").isNotNull(), _name()
    input_kind = F.lower(F.coalesce(attribute("type"), F.when(F.col("tag") == "textarea", "textarea").otherwise("text")))
    field = _param(
        name, F.when(in_form, "body").otherwise("unknown"), F.when(in_form, "high").otherwise("medium"), rendered(F.col("tag"), FIELD_KEYS), inferred_type=C.inferred_type(name, input_kind), default=attribute("value"), required=has("required"),
        route=F.col("form_action"), source=F.lit("html_form_parser"),
    )
    values = F.array_distinct(F.filter(F.transform("options", lambda o: C.strip(o["value"])), lambda v: v != ""))
    select = _param(
        name, F.lit("body"), F.lit("high"), rendered(F.col("tag"), ["name", "required", "disabled"]), inferred_type=F.when(F.size(values) > 0, "enum").otherwise("string"), required=has("required"), options=values,
        route=F.col("form_action"), source=F.lit("html_form_parser"),
    )
    form = _query_structs(F.col("form_action"), F.lit("high"), "html_form_parser")
    found = F.when((own == "form") & F.col("form_action").isNotNull(), form).when((own == "field") & (name != ""), F.array(field)).when((own == "select") & (name != ""), F.array(select)).otherwise(none)
    markup = events.where("kind IN ('form', 'field', 'select')").withColumn("p", F.explode(found)).select("source_file", _seq(0, "pos").alias("seq"), "p.*")
    matched = script_rows(sources, ["call", "literal", "append", "getter"])
    family, url, data, evidence = F.col("family"), F.col("url"), F.col("data"), F.col("evidence")
    valid = lambda names: F.filter(names, C.is_param_name)
    queries = F.when(family.isin("call", "literal") & C.looks_like_route(url), _query_structs(url, F.col("confidence"), "param_name_miner")).otherwise(none)
    keys = F.flatten(F.transform(F.regexp_extract_all(data, F.lit(OBJECT_DATA), F.lit(1)), lambda o: F.regexp_extract_all(o, F.lit(OBJECT_FIELD), F.lit(1))))
    objects = F.transform(valid(F.filter(keys, lambda n: ~F.lower(n).isin(V.OBJECT_KEYS))), lambda n: _param(n, F.lit("body"), F.lit("high"), evidence, route=url))
    encoded = F.transform(valid(F.regexp_extract_all(data, F.lit(URLENCODED), F.lit(1))), lambda n: _param(n, F.lit("body"), F.lit("medium"), evidence, route=url))
    sent = F.when((family == "call") & ~F.col("kind").isin("open", "object"), F.concat(objects, encoded)).otherwise(none)
    one = F.when(~F.coalesce(C.is_param_name(F.col("name")), F.lit(False)), none).when(family == "append", F.array(_param(F.col("name"), F.col("kind"), F.lit("medium"), evidence))).when(family == "getter", F.array(_param(F.col("name"), F.lit("template"), F.lit("low"), evidence, source=F.lit("template_parser")))).otherwise(none)
    mined = matched.withColumn("p", F.explode(F.concat(queries, sent, F.coalesce(one, none)))).select("source_file", "seq", "p.*")
    rows = markup.unionByName(mined).withColumn("inferred_type", F.coalesce("inferred_type", C.inferred_type(F.col("name"), F.lit("text"))))
    return merge_evidence(rows, ["source_file", "name", "location", "route"], first=("inferred_type",), known=("default", "required"), sources="source", confidence="confidence", lists=("options",), cap=10)


def constraints(sources: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source_file, param, kind, value: what form markup demands of its fields."""
    events = html_events(sources) if events is None else events
    fields = events.where("kind = 'field'").withColumn("name", _name()).where("name <> ''")
    hidden = (F.lower(F.coalesce(attribute("type"), F.lit("text"))) == "hidden") & C.any_word(F.lower("name"), V.SECRET_WORDS)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    known = [F.when(F.coalesce(attribute(a), F.lit("")) != "", pair(k, attribute(a))) for a, k in (("maxlength", "max_length"), ("minlength", "min_length"), ("min", "min"), ("max", "max"), ("pattern", "regex"))]
    known += [F.when(has(a), pair(a, F.lit("true"))) for a in ("required", "disabled", "readonly")] + [F.when(hidden, pair("security_token", F.lit("hidden_input")))]
    own = fields.withColumn("c", F.explode(F.array_compact(F.array(*known))))
    own = own.select("source_file", F.col("name").alias("param"), "c.kind", "c.value", F.concat(F.lit("input:"), "name").alias("source"), rendered(F.col("tag"), FIELD_KEYS).alias("evidence"), _seq(0, "pos").alias("seq"))
    values = F.array_distinct(F.filter(F.transform("options", lambda o: C.strip(o["value"])), lambda v: v != ""))
    chosen = [F.when(F.size(values) > 0, pair("enum", F.array_join(values, "|")))] + [F.when(has(a), pair(a, F.lit("true"))) for a in ("required", "disabled")]
    selects = events.where("kind = 'select'").withColumn("name", _name()).where("name <> ''").withColumn("c", F.explode(F.array_compact(F.array(*chosen))))
    selects = selects.select("source_file", F.col("name").alias("param"), "c.kind", "c.value", F.concat(F.lit("select:"), "name").alias("source"), rendered(F.col("tag"), ["name", "required", "disabled"]).alias("evidence"), _seq(0, "pos").alias("seq"))
    forms = events.where("kind = 'form'").withColumn("value", F.lower(C.strip(F.coalesce(attribute("enctype"), F.lit(""))))).where("value <> ''")
    forms = forms.select("source_file", F.lit("*").alias("param"), F.lit("content_type").alias("kind"), "value", F.concat(F.lit("form:"), F.coalesce("form_action", F.lit("<unknown>"))).alias("source"), rendered(F.col("tag"), ["enctype"]).alias("evidence"), _seq(0, "pos").alias("seq"))
    rows = own.unionByName(selects).unionByName(forms).withColumn("confidence", F.lit("high"))
    return merge_evidence(rows, ["source_file", "param", "kind", "value"], sources="source", confidence="confidence", cap=10)


def hints(sources: DataFrame, words: dict[str, str], events: DataFrame | None = None) -> DataFrame:
    """source_file, kind, value, source: texts, names and addresses that speak of the given keywords. Pages are parsed and searched once."""
    events = html_events(sources) if events is None else events
    own, text, name, shown = F.col("kind"), F.col("text"), _name(), rendered(F.col("tag"), FIELD_KEYS)
    hint = lambda value, source, confidence, evidence: F.struct(value.alias("value"), source.alias("source"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))
    of_field = [hint(name, F.concat(F.lit("param:"), name), "high", shown), F.when(F.coalesce(attribute("value"), F.lit("")) != "", hint(attribute("value"), F.concat(F.lit("default:"), name), "medium", shown))]
    if words is V.AUTH_WORDS:
        secret = (F.lower(F.coalesce(attribute("type"), F.lit("text"))) == "hidden") & C.any_word(F.lower(name), V.SECRET_WORDS)
        of_field.append(F.when(secret, hint(name, F.concat(F.lit("input:"), name), "high", shown)))
    of_event = (
        F.when((own == "ref") & (text != "") & ~F.startswith(text, F.lit("#")), F.array(hint(text, F.concat_ws(":", "tag", "text"), "medium", text)))
        .when((own == "meta") & (text != ""), F.array(hint(text, rendered(F.lit("meta"), ["name", "http-equiv", "content"]), "medium", text)))
        .when(own == "text", F.array(hint(text, F.concat("tag", F.lit(" text:"), "text"), "medium", text)))
        .when((own == "field") & (name != ""), F.array_compact(F.array(*of_field)))
    )
    of_markup = events.where("kind IN ('ref', 'meta', 'text', 'field')").withColumn("h", F.explode(of_event)).select("source_file", "h.*", _seq(0, "pos").alias("seq"))
    calls = script_calls(sources).where(C.looks_like_route(F.col("url")))
    mined = F.col("kind") == "object"
    of_script = calls.select("source_file", F.col("url").alias("value"), F.when(mined, "js_object_route_miner").otherwise("js_api_parser").alias("source"), F.when(mined, "medium").otherwise("high").alias("confidence"), "evidence", _seq(2, "rule_no", "match_no").alias("seq"))
    whole = of_markup.unionByName(of_script)
    whole = whole.withColumn("kind", C.keyword_kind(F.col("value"), words)).where("kind IS NOT NULL")
    return merge_evidence(whole, ["source_file", "kind", "value", "source"], confidence="confidence", cap=10)


def template_vars(sources: DataFrame) -> DataFrame:
    """source_file, name, function: what server-side templates read, and their other expressions."""
    text = sources.select("source_file", "content")
    getters = matches(text, "content", GETTERS, ["function", "name"]).select("source_file", "name", "function", F.lit("template_parser").alias("source"), F.lit("medium").alias("confidence"), C.collapse(F.col("matched")).alias("evidence"), _seq(0, "match_no").alias("seq"))
    others = matches(text, "content", EXPRESSIONS, ["name"]).withColumn("clean", C.collapse(F.col("name")))
    others = others.select("source_file", F.substring("clean", 1, 120).alias("name"), F.lit("template_expression").alias("function"), F.lit("template_parser").alias("source"), F.lit("low").alias("confidence"), F.col("clean").alias("evidence"), _seq(1, "match_no").alias("seq"))
    return merge_evidence(getters.unionByName(others), ["source_file", "name", "function"], first=("source",), confidence="confidence", cap=10)


def ui_context(sources: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source_file and entry: titles, headings, labels, captions, and the page's file name."""
    events = html_events(sources) if events is None else events
    label_for = F.coalesce(attribute("for"), F.lit(""))
    entry = F.when(F.col("tag") == "title", F.concat(F.lit("title:"), "text")).when(F.col("tag").isin("h1", "h2", "h3"), F.concat(F.lit("heading:"), "text")).when(F.col("tag") == "label", F.concat(F.lit("label:"), "text", F.when(label_for != "", F.concat(F.lit(" for="), label_for)).otherwise(""))).otherwise(F.concat("tag", F.lit(":"), "text"))
    texts = events.where("kind = 'text'").select("source_file", entry.alias("entry"))
    name = F.coalesce(F.nullif(C.base_name(F.col("source_file")), F.lit("")), F.lit("<inline>"))
    return texts.unionAll(sources.select("source_file", F.concat(F.lit("page_filename:"), name))).distinct()


def references(sources: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source_file and ref: every address that a page names."""
    events = html_events(sources) if events is None else events
    own = events.where("kind = 'ref' AND text <> '' AND NOT startswith(text, '#')").select("source_file", F.col("text").alias("ref")).unionAll(events.where("kind = 'form' AND form_action IS NOT NULL").select("source_file", "form_action"))
    mined = script_calls(sources).where(C.looks_like_route(F.col("url"))).select("source_file", "url").unionAll(matches(sources.select("source_file", "content"), "content", INLINE, ["url"]).select("source_file", "url"))
    literal = matches(sources.select("source_file", "content"), "content", LITERALS, ["url"]).where(C.looks_like_route(F.col("url"))).select("source_file", "url")
    return own.unionAll(mined).unionAll(literal).distinct()


def form_facts(sources: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """What markup alone gives: routes of forms and links, constraints of fields, and interface texts."""
    events = html_events(sources) if events is None else events
    rows = _route_rows(events)
    fused = merge_evidence(rows, ["source_file", "url", "method"], known=("ui_context",), sources="source", confidence="confidence", cap=10)
    return {"routes": fused, "constraints": constraints(sources, events), "ui_context": ui_context(sources, events)}


def script_hints(sources: DataFrame, words: dict[str, str]) -> DataFrame:
    """source_file, kind, value, source and confidence of addresses in script text that speak of the given keywords."""
    calls = script_calls(sources).where(C.looks_like_route(F.col("url"))).withColumn("kind_", C.keyword_kind(F.col("url"), words)).where("kind_ IS NOT NULL")
    mined = F.col("kind") == "object"
    rows = calls.select("source_file", F.col("kind_").alias("kind"), F.col("url").alias("value"), F.when(mined, "js_object_route_miner").otherwise("js_api_parser").alias("source"), F.when(mined, "medium").otherwise("high").alias("confidence"), "evidence", _seq(2, "rule_no", "match_no").alias("seq"))
    return merge_evidence(rows, ["source_file", "kind", "value", "source"], confidence="confidence", cap=10)


def facts(sources: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """All fact tables of pages, each fused for its page. events: html_events(sources), if the caller has written them."""
    events = html_events(sources) if events is None else events
    return {
        "routes": routes(sources, events), "params": params(sources, events), "constraints": constraints(sources, events), "auth_hints": hints(sources, V.AUTH_WORDS, events), "state_hints": hints(sources, V.STATE_WORDS, events),
        "template_vars": template_vars(sources),
    }
