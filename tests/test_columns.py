"""Scalar functions, with the cases that are easy to get wrong."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions import vocabulary as V


def evaluated(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_lines_end_like_text_lines(spark):
    assert evaluated(spark, C.lines_of, "a\r\nb c\n", "", "\n", "a\n\nb") == [["a", "b", "c"], [], [""], ["a", "", "b"]]


def test_comments_are_cut_at_the_first_marker_only(spark):
    assert evaluated(spark, C.without_comment, " a # b", "a#b # c", "# x", "http://h // y", "a // b", "") == ["a", "a#b # c", "", "http://h // y", "a", ""]


def test_values_lose_semicolons_and_one_pair_of_quotes(spark):
    assert evaluated(spark, C.clean_value, ' "a";', "'b'", '"c', "d;;", '""', "") == ["a", "b", '"c', "d", "", ""]


def test_addresses(spark):
    got = evaluated(spark, C.address_and_port, "80", "1.2.3.4:81;", "[::1]:82", "https://*:83", ":84", "none", "99999", None)
    assert [(r.address, r.port) for r in got] == [(None, 80), ("1.2.3.4", 81), ("::1", 82), ("*", 83), (None, 84), (None, None), (None, None), (None, None)]


def test_routes(spark):
    assert evaluated(spark, C.looks_like_route, "/a", "./b", "x.cgi?y=1", "a/b.html", "x.stm", "/x.stm", "http://h/x.cgi", "/a.css?v=1", "javascript:x", "für/x.asp", "", None) == [True, True, True, True, False, True, False, False, False, True, False, False]


def test_keywords_in_order(spark):
    assert evaluated(spark, lambda x: C.keyword_kind(x, V.AUTH_WORDS), "author", "passwd", "my-sid", "inside", "plain") == ["auth", "password", "session", None, None]
    assert evaluated(spark, lambda x: C.keyword_kind(x, V.STATE_WORDS), "commit", "Save") == ["save", "save"]


def test_types_from_parts_of_names(spark):
    assert evaluated(spark, lambda x: C.inferred_type(x, F.lit("text")), "description", "port", "mac", "onoff", "other") == ["ipv4_or_host", "int", "mac", "bool_or_enum", "string"]


@pytest.mark.parametrize(("link", "expected"), [("/a#b", "http://h/a"), ("b.html", "http://h/d/b.html"), ("../c", "http://h/c"), ("?q=1", "http://h/d/p.html?q=1"), ("//o/x", "http://o/x"), ("https://o/y#z", "https://o/y"), ("mailto:x", None), ("#t", None), ("ftp://x", None), ("./", "http://h/d/")])
def test_normalized_urls(spark, link, expected):
    assert evaluated(spark, lambda x: C.normalized_url(F.lit("http://h/d/p.html?x=1"), x), link) == [expected]


def test_query_pairs_keep_blanks(spark):
    got = evaluated(spark, C.query_pairs, "/a?x=1&y=&z&w=a%20b+c#f", "/a", "/a?bad=%zz")
    assert [[(p.name, p.value) for p in row] for row in got] == [[("x", "1"), ("y", ""), ("z", ""), ("w", "a b c")], [], [("bad", "%zz")]]


def test_strings_of_binaries(spark):
    assert evaluated(spark, C.string_tags, "/bin/sh", "login failed.", "HTTP_HOST", "ident_1", "??", "x.cgi", "loginpage") == [["route"], ["auth", "response"], ["env"], ["identifier"], [], ["route"], ["auth"]]


def test_string_types_and_accesses(spark):
    assert evaluated(spark, C.string_type, "token", "ok error", "/x", "y") == ["success_hint", "error_hint", "path_or_route", "generic"]
    assert evaluated(spark, C.source_access, "nvram_unset", "nvram_set", "uci_commit") == ["get", "set", "commit"]
    assert evaluated(spark, C.binary_access, "nvram_unset", "nvram_get") == ["write", "read"]


def test_c_strings_keep_escapes(spark):
    assert evaluated(spark, C.c_strings, r'f("a\"b", "c")', "none") == [[r"a\"b", "c"], []]


def test_large_addresses(spark):
    assert [str(x) for x in evaluated(spark, C.address_number, "0xffffffffffffffff", "0x10")] == ["18446744073709551615", "16"]


def test_options(spark):
    rows = spark.createDataFrame([(["httpd", "-p", "80", "-h/www"],), (["-port"],), ([],)], "argv array<string>")
    assert [(r.p, r.h) for r in rows.select(C.option_value(F.col("argv"), ["-p"]).alias("p"), C.option_value(F.col("argv"), ["-h"]).alias("h")).collect()] == [("80", "/www"), ("ort", None), (None, None)]


def test_snapshot_names(spark):
    assert evaluated(spark, C.snapshot_name, "http://h/a b?c=1") == ["http_h__a_b_c_1_" + hashlib.sha1(b"http://h/a b?c=1").hexdigest()[:10] + ".html"]


def test_shell_tokens_and_quoting_equal_those_of_python(spark):
    import random
    import shlex

    rng = random.Random(12)
    lines = ["", " ", "a", "''", '""', "a''b", "\\", "'", '"\\"', "a\\ b", '"a\\b\\"c\\\\"', "x\x0by\u00a0z w", "tab\tcr\rnl\nend"] + ["".join(rng.choice("ab '\"\\\t=é") for _ in range(rng.randrange(1, 14))) for _ in range(600)]

    def plain(line):
        try:
            return shlex.split(line, comments=False, posix=True)
        except ValueError:
            return line.split()

    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    for r in rows.select("line", C.shell_tokens(F.col("line")).alias("words"), C.quoted(F.col("line")).alias("shown")).collect():
        assert r.words == plain(r.line), r.line
        assert r.shown == repr(r.line)


def test_needed_texts_never_hide_a_match(spark):
    import random

    from factweave.operators import backend, binary, frontend, rules, serverconfig

    assert rules.needed(r"\b(?:open|fopen)\s*\(") == ["open"] and rules.needed(r"(?:ab)?c*") is None and rules.needed(r"x(?:foo|barbar)[0-9]+") == ["barbar", "foo"]
    rng = random.Random(5)
    words = ["websGetVar(wp, \"a\", b)", "strlen(x) > 3", "nvram_set(\"k\", v)", "Listen 80", "LOCATION /x {", "alias /y;", "$.post('/a.cgi', 'b=1')", "location.href='/c.asp'", "\u212a", "\u017f", "ſystem(x)", "system(y)", "fetch('/z.cgi')", "if (n == 3)", "\"/goform/q\"", "Require valid", "{{a}}", "é"]
    lines = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))),) for _ in range(150)], "line string")
    lists = [v for m in (backend, frontend, serverconfig, binary) for v in vars(m).values() if isinstance(v, list) and v and isinstance(v[0], rules.Rule)]
    assert len(lists) > 15
    for own in lists:
        fields = sorted({f for r in own for f in r.fields})
        with_all = [rules.every_match("line", own, fields).alias("a"), rules.first_match("line", own, fields).alias("b")]
        kept, rules.MOST_TEXTS = rules.MOST_TEXTS, 0
        without = [rules.every_match("line", own, fields).alias("c"), F.filter(rules.every_match("line", own, fields), lambda m: m["match_no"] == 0).alias("d")]
        rules.MOST_TEXTS = kept
        for r in lines.select("line", *with_all, *without).collect():
            assert r.a == r.c and r.b == r.d, r.line
