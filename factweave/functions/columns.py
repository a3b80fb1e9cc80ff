"""Scalar functions as Column builders; all run inside the JVM.

Patterns are Java ones; (?U) gives \\w, \\s, \\d and \\b their Unicode meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V

LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
C_STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def lines_of(text: Column) -> Column:
    """array<string> of lines; the end of the last line begins no other one."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, limit: int = 220) -> Column:
    clean = strip(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 3), F.lit("...")))


def without_comment(line: Column) -> Column:
    """A line without its comment: each marker's first place counts, at the start or after white space."""

    def cut(text: Column, marker: str) -> Column:
        at = F.instr(text, marker)
        spaced = F.substring(text, at - 1, F.lit(1)).rlike(r"(?U)\s")
        return F.when(at == 1, F.lit("")).when((at > 1) & spaced, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?U)\s+$", "")).otherwise(text)

    return let(let(strip(line), lambda x: cut(x, "#")), lambda x: cut(x, "//"))


def clean_value(text: Column) -> Column:
    """Stripped, without semicolons at the end and without one pair of quotes around it."""

    def unquoted(bare: Column) -> Column:
        quoted = (F.length(bare) >= 2) & F.substring(bare, 1, 1).isin("'", '"') & (F.substring(bare, 1, 1) == F.substring(bare, -1, 1))
        return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)

    return let(F.regexp_replace(strip(text), ";+$", ""), unquoted)


def to_port(text: Column) -> Column:
    return let(F.nullif(F.regexp_extract(text, r"\d{1,5}", 0), F.lit("")).cast("int"), lambda port: F.when(port.between(0, 65535), port))


def address_and_port(raw: Column) -> Column:
    """struct<address, port> of "[v6]:port", "host:port" or "port"."""

    def parsed(value: Column) -> Column:
        split_off = value.contains(":") & ~value.rlike(r"^\d+$")
        host = F.regexp_extract(value, r"^(.*):([^:]*)$", 1)
        bracketed = value.startswith("[") & value.contains("]:")
        address = F.when(bracketed, F.regexp_replace(host, r"^[\[\]]+|[\[\]]+$", "")).when(split_off, F.nullif(host, F.lit("")))
        return F.struct(address.alias("address"), to_port(F.when(split_off, F.regexp_extract(value, r"^(.*):([^:]*)$", 2)).otherwise(value)).alias("port"))

    return let(F.regexp_replace(clean_value(raw), "https?://", ""), parsed)


def c_strings(text: Column) -> Column:
    """All C string literals of a text, without their quotes."""
    return F.regexp_extract_all(text, F.lit(C_STRING), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def any_word(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in a text that is in lower case."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def keyword_kind(text: Column, words: dict[str, str]) -> Column:
    """Kind of the first listed keyword that occurs; sid only between other characters than letters and digits."""
    lower = F.lower(text)
    found = F.lit(None).cast("string")
    for word, kind in reversed(list(words.items())):
        hit = lower.rlike(r"(^|[^a-z0-9])sid([^a-z0-9]|$)") if word == "sid" else lower.contains(word)
        found = F.when(hit, F.lit(kind)).otherwise(found)
    return found


def is_static_asset(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(" + "|".join(V.STATIC_SUFFIXES) + ")$")


def looks_like_route(url: Column) -> Column:
    value = strip(url)
    lower = F.lower(value)
    foreign = lower.rlike("^(https?://|mailto:|javascript:)")
    page = value.rlike(r"""(?U)(?:^|[A-Za-z0-9_.-])[\w./-]+\.(?:cgi|asp|php|htm|html)(?:\?[^'"\s<>]*)?$""")
    return F.coalesce((value != "") & ~foreign & ~is_static_asset(value) & (value.rlike(r"^(/|\./|\.\./)") | page), F.lit(False))


def is_param_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_.:\-\[\]]{0,95}$")


def method_of(raw: Column) -> Column:
    upper = F.upper(F.regexp_replace(strip(raw), """^['"]+|['"]+$""", ""))
    return F.when(upper.isin(V.METHODS), upper).otherwise("GET")


def inferred_type(name: Column, input_type: Column) -> Column:
    """Type of a field from its input type, else from parts of its name."""
    kind, lower = F.lower(input_type), F.lower(name)
    out = F.when(kind.isin("checkbox", "radio"), "bool_or_enum").when(kind.isin("number", "range"), "int").when(kind == "password", "sensitive_string").when(kind == "file", "file")
    for parts, label in V.NAME_TYPES:
        out = out.when(any_word(lower, parts), label)
    return out.otherwise("string")


def confidence_rank(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.CONFIDENCES)), label) - 1


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, V.CONFIDENCES)), (rank + 1).cast("int"))


def query_pairs(url: Column) -> Column:
    """array<struct<name, value>> of a URL's query, decoded; names without a value have an empty one."""
    query = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(parts, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))


def source_param_source(api: Column, param: Column, line: Column) -> Column:
    """Where a parameter read in source text comes from; the whole line counts."""
    a, p, t = F.lower(api), F.lower(param), F.lower(line)
    return (
        F.when(a.contains("cookie") | t.contains("cookie") | p.contains("cookie"), "cookie").when(a.contains("header") | p.contains("http_"), "header").when(a.contains("env"), "env")
        .when(a.contains("query") | t.contains("query_string"), "query").when(any_word(a, ["form", "post", "body"]), "body").otherwise("unknown")
    )


def binary_param_source(api: Column, param: Column, context: Column) -> Column:
    """The same for text recovered from binaries, where the rules differ."""
    a, p, t = F.lower(api), F.lower(param), F.lower(context)
    return (
        F.when(a.contains("cookie") | p.contains("cookie"), "cookie").when(a.contains("header") | p.contains("http_"), "header").when(a.contains("getenv") | p.contains("query_string"), "env")
        .when(a.contains("query") | t.contains("query_string"), "query").when(a.contains("form") | t.contains("post") | t.contains("content_length"), "body").otherwise("unknown")
    )


def source_access(api: Column) -> Column:
    return F.when(api.endswith("commit"), "commit").when(api.contains("_set"), "set").otherwise("get")


def binary_access(api: Column) -> Column:
    return F.when(api.rlike("(_set|_commit|_unset)$"), "write").otherwise("read")


def string_type(value: Column) -> Column:
    lower = F.lower(value)
    return F.when(any_word(lower, ["error", "fail", "invalid", "unauthorized"]), "error_hint").when(any_word(lower, ["success", "ok", "done"]), "success_hint").when(value.startswith("/"), "path_or_route").otherwise("generic")


def string_tags(value: Column) -> Column:
    """Tags of a string found in a binary: route, auth, state and response, else env or identifier."""
    lower = F.lower(value)
    route = value.rlike(r"(?i)(?:^/|/goform/|/cgi-bin/|/HNAP1/|/hnap1/|(?:^|/)[^/\s]+\.(?:cgi|asp|htm|html)$)")
    tags = F.filter(
        F.array(
            F.when(route, "route"), F.when(any_word(lower, V.STRING_AUTH_WORDS), "auth"), F.when(any_word(lower, V.STRING_STATE_WORDS), "state"),
            F.when(any_word(lower, V.STRING_RESPONSE_WORDS) & value.rlike("[ ._]"), "response"),
        ),
        lambda x: x.isNotNull(),
    )
    env = value.startswith("HTTP_") | value.isin("QUERY_STRING", "CONTENT_LENGTH", "REQUEST_METHOD")
    other = F.when(env, F.array(F.lit("env"))).when(value.rlike(r"^[A-Za-z_][A-Za-z0-9_.:-]{2,64}$"), F.array(F.lit("identifier"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tags) > 0, tags).otherwise(other)


def is_reference(value: Column) -> Column:
    return value.rlike(r"(?i)(?:/www/|/etc/|/tmp/|/var/|\.asp$|\.cgi$|\.htm$|\.html$|/goform/|/cgi-bin/|/HNAP1/|query_string|content_length|http_cookie|request_method)")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def without_dots(path: Column) -> Column:
    """A path with its "." and ".." segments worked off, left to right."""
    steps = F.aggregate(
        F.split(F.regexp_replace(path, "^/", ""), "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    joined = F.concat(F.lit("/"), F.array_join(steps, "/"))
    return let(joined, lambda j: F.when(path.rlike(r"(^|/)\.\.?$") & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))


def normalized_url(base: Column, candidate: Column) -> Column:
    """Absolute http(s) URL without its fragment, or null. Absolute, host-relative, root-relative, query-only and relative ones."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), F.lit("/"))

    def resolved(bare: Column) -> Column:
        tail, own = F.regexp_extract(bare, r"(\?.*)$", 1), F.regexp_replace(bare, r"\?.*$", "")
        relative = F.concat(site, let(F.when(bare.startswith("/"), own).otherwise(F.concat(folder, own)), without_dots), tail)
        return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, bare)).when(bare.startswith("?"), F.concat(site, path, bare)).otherwise(relative)

    value = strip(candidate)
    skipped = (value == "") | value.rlike("^(javascript:|mailto:|tel:|#)")
    return let(let(F.regexp_replace(value, "#.*$", ""), resolved), lambda url: F.when(~skipped & url.rlike("(?i)^https?://"), url))


def snapshot_name(url: Column) -> Column:
    """File name of a saved page: a slug of the URL's parts and ten hexadecimal digits of its SHA-1."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1)
    slug = F.regexp_replace(F.regexp_replace(F.concat_ws("_", scheme, site, path, query), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.substring(slug, 1, 120), F.lit("_"), F.substring(F.sha1(url), 1, 10), F.lit(".html"))


def address_number(address: Column) -> Column:
    """Number of a hexadecimal address; 64 bits without sign, so a decimal."""
    return F.conv(F.regexp_replace(F.lower(address), "^0x", ""), 16, 10).cast("decimal(20,0)")


def option_value(argv: Column, names: list[str]) -> Column:
    """What follows the first of the options in a token list, or what is glued to it."""
    places = F.sequence(F.lit(0), F.greatest(F.size(argv) - 1, F.lit(0)))

    def at(i: Column) -> Column:
        token, after = F.get(argv, i), F.get(argv, i + 1)
        glued = F.coalesce(*(F.when(token.startswith(n) & (F.length(token) > len(n)), F.substring(token, F.lit(len(n) + 1), F.length(token))) for n in names))
        return F.when(token.isin(names), after).otherwise(glued)

    return F.get(F.filter(F.transform(places, at), lambda x: x.isNotNull()), F.lit(0))


#: A piece of a shell word: plain characters, an escaped one, or a quoted stretch.
SHELL_PIECE = r"""[^ \t\r\n'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+\""""


def shell_tokens(line: Column) -> Column:
    """The words of a line as a POSIX shell sees them, without comments; where a quote or an escape is left open, what stands between
    white space.

    Quotes and backslashes go; between double quotes a backslash goes before a double quote or a backslash only.
    """
    word = rf"(?s)(?:{SHELL_PIECE})++"
    whole = line.rlike(rf"(?s)^[ \t\r\n]*+(?:(?:{SHELL_PIECE})++[ \t\r\n]*+)*+$")

    def bare(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return F.when(piece.startswith("'"), inner).when(piece.startswith('"'), F.regexp_replace(inner, r"""(?s)\\(["\\])""", "$1")).when(piece.startswith("\\"), F.substring(piece, F.lit(2), F.lit(1))).otherwise(piece)

    words = F.transform(F.regexp_extract_all(line, F.lit(word), F.lit(0)), lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"(?s){SHELL_PIECE}"), F.lit(0)), bare), ""))
    return F.when(whole, words).otherwise(F.filter(F.split(line, r"(?U)\s+"), lambda x: x != ""))


def quoted(text: Column) -> Column:
    """A text as Python's repr shows it, for tags in evidence: in single quotes, or in double ones if it holds single ones alone."""
    mark = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        small = F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code), 2, "0")))
        return F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when((code < 32) | code.between(127, 160) | (code == 173), small).otherwise(c)

    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    body = F.when(text.contains("'") & text.contains('"'), F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)
    body = F.when(body.rlike(r"[\x00-\x1f\x7f-\xa0\xad]"), F.array_join(F.transform(F.split(body, ""), shown), "")).otherwise(body)
    return F.concat(mark, body, mark)


def elapsed_seconds(began: Column, ended: Column) -> Column:
    """Seconds between two times, to the millisecond."""
    micros = lambda at: F.unix_micros(at.cast("timestamp"))
    return F.round((micros(ended) - micros(began)) / 1_000_000, 3)
