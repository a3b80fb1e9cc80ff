"""Extractors on hand-written inputs."""

import json

from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.operators import backend, binary, crawl, frontend, fuse, serverconfig
from factweave.plans import corpora
from factweave.sources import bundles, sinks
from factweave.streaming import arrivals

PAGE = """<title>WAN</title><form action="/apply.cgi?next=wan" method="post"><input name="wan_ip" maxlength="15" required><input type="hidden" name="csrf_token" value="x"><select name="mode"><option value="dhcp">D</option><option>none</option></select></form><ul><li><a href="/status.asp">S</a></li></ul>"""
CONF = """# comment
Listen 80
DocumentRoot "/www"
ScriptAlias /cgi-bin/ /www/cgi-bin/
Alias /icons/ /www/icons/
AddHandler cgi-script .cgi
location /static/ {
  alias /srv/static/;
}
AuthUserFile /etc/.htpasswd
include /etc/extra.conf
/usr/sbin/httpd -p 8080 -h /www -c /etc/httpd.conf
"""
SOURCE = """#include "webs.h"
{ "status", status_handler },
websFormDefine("setWan", formSetWan);
char *ip = websGetVar(wp, "wan_ip", "0.0.0.0");
if (strlen(ip) > 15) return;
nvram_set("wan_ip", ip); nvram_commit();
nvram_unset("old_key");
system(cmd);
"""


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_page(spark):
    page = spark.createDataFrame([("wan.htm", PAGE)], "source_file string, content string")
    assert rows(frontend.routes(page), "url", "method", "confidence", "source", "ui_context") == [
        ("/apply.cgi?next=wan", "GET", "medium", "regex_route_miner", "WAN"), ("/apply.cgi?next=wan", "POST", "high", "html_form_parser", "WAN"), ("/status.asp", "GET", "medium", "html_link_parser|regex_route_miner", "WAN"),
    ]
    params = {r.name: r for r in frontend.params(page).collect()}
    assert (params["next"].location, params["next"].default, params["next"].source) == ("query", "wan", "html_form_parser|param_name_miner")
    assert (params["wan_ip"].inferred_type, params["wan_ip"].required) == ("ipv4_or_host", True)
    assert (params["csrf_token"].default, params["csrf_token"].required) == ("x", False)
    assert (params["mode"].inferred_type, params["mode"].options) == ("enum", ["dhcp"])
    assert rows(frontend.constraints(page), "param", "kind", "value") == [("csrf_token", "security_token", "hidden_input"), ("mode", "enum", "dhcp"), ("wan_ip", "max_length", "15"), ("wan_ip", "required", "true")]
    assert rows(frontend.hints(page, V.AUTH_WORDS), "kind", "value", "source") == [("csrf", "csrf_token", "input:csrf_token"), ("csrf", "csrf_token", "param:csrf_token")]
    assert frontend.hints(page, V.STATE_WORDS).count() == 0
    assert rows(frontend.ui_context(page), "entry") == [("a:S",), ("option:D",), ("option:none",), ("page_filename:wan.htm",), ("title:WAN",)]
    assert rows(frontend.references(page), "ref") == [("/apply.cgi?next=wan",), ("/status.asp",)]


def test_crawl(spark):
    pages = spark.createDataFrame([("http://h/x.asp", PAGE)], "url string, html string")
    assert rows(crawl.endpoints(pages), "method", "path", "risky", "form_field_names") == [("GET", "/x.asp", None, []), ("POST", "/apply.cgi", True, ["csrf_token", "mode", "wan_ip"])]
    template = crawl.seed_templates(pages).first()
    assert (template.target, template.form_id, template.seed_values) == ("http://h/apply.cgi?next=wan", "form_1", {"csrf_token": "x"})
    radios = spark.createDataFrame([("http://h/", '<form><input type=radio name=a value=1><input type=radio name=a value=2><input type=checkbox name=c value=9></form>')], "url string, html string")
    assert crawl.seed_templates(radios).first().seed_values == {"a": "2", "c": ""}
    assert rows(crawl.links(pages), "pos", "link") == [(0, "http://h/status.asp")]


def test_cyclic_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "url string, link string")
    assert rows(crawl.reachable(edges, spark.createDataFrame([("a",)], "url string")), "url", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_configuration(spark):
    conf = spark.createDataFrame([("b", "boa.conf", CONF)], "bundle_id string, source_file string, content string")
    assert rows(serverconfig.servers(conf), "type", "confidence") == [("boa", "low"), ("httpd", "medium"), ("nginx", "medium")]
    assert sorted((r.port, r.protocol, len(r.evidence)) for r in serverconfig.listeners(conf).collect()) == [(80, "http", 2), (8080, "http", 1)]
    assert [(r.root_type, r.path, len(r.evidence)) for r in serverconfig.document_roots(conf).collect()] == [("document_root", "/www", 2)]
    assert rows(serverconfig.aliases(conf), "url_prefix", "filesystem_path") == [("/icons/", "/www/icons/"), ("/static/", "/srv/static/"), (None, "/icons/ /www/icons/")]
    assert rows(serverconfig.cgi_mappings(conf), "mapping_type", "url_prefix", "handler", "extension") == [("add_handler", None, ".cgi", None), ("cgi_bin", "/cgi-bin/", None, None), ("cgi_extension", None, None, ".cgi"), ("script_alias", "/cgi-bin/", None, None)]
    assert rows(serverconfig.auth_rules(conf), "rule_type", "value") == [("htpasswd", "/etc/.htpasswd"), ("password_file", "/etc/.htpasswd")]
    assert rows(serverconfig.startup_commands(conf), "command", "port", "document_root", "config_path") == [("httpd", "8080", "/www", "/etc/httpd.conf")]
    assert rows(serverconfig.config_references(conf), "reference_type", "path") == [("command_option", "/etc/httpd.conf"), ("include", "/etc/extra.conf")]
    assert rows(serverconfig.routes(conf), "route", "route_type") == [(".cgi", "cgi_mapping"), ("/cgi-bin/", "cgi_mapping"), ("/icons/", "alias"), ("/static/", "alias")]
    assert rows(serverconfig.path_references(conf), "path") == [("/etc/extra.conf",), ("/etc/httpd.conf",), ("/www",)]


def test_backend_source(spark):
    source = spark.createDataFrame([("a.c", SOURCE)], "source_file string, content string")
    facts = lambda table, *names: rows(backend.facts(source, table), *names)
    assert facts("handlers", "handler", "kind", "line") == [("formSetWan", "registration", 3), ("status_handler", "dispatch_table", 2)]
    assert facts("route_mappings", "route", "handler") == [("setWan", "formSetWan"), ("status", "status_handler")]
    assert facts("params", "param", "read_api", "param_source", "default_value") == [("setWan", "websFormDefine", "body", None), ("wan_ip", "websGetVar", "unknown", '"0.0.0.0"')]
    assert facts("constraints", "constraint_type", "target", "operator", "value") == [("strlen_compare", "ip", ">", "15")]
    assert facts("config_accesses", "api", "access_type", "config_key") == [("nvram_set", "set", "wan_ip"), ("nvram_unset", "get", "old_key")]
    assert facts("sinks", "sink_category", "api") == [("command", "system"), ("config_state", "nvram_commit")]
    assert facts("references", "value") == [("webs.h",)]
    assert len(facts("strings", "string")) == 6


def test_fusion_does_not_depend_on_partitions(spark):
    facts = spark.createDataFrame([(None, k, f"e{k % 15}", ["low", "high"][k % 2], None if k < 3 else f"v{k}") for k in range(60)], "key string, seq int, evidence string, confidence string, value string")
    merged = [fuse.merge_evidence(facts.repartition(n), ["key"], known=("value",), confidence="confidence", cap=10).collect() for n in (1, 7)]
    assert merged[0] == merged[1] and merged[0][0].evidence == [f"e{k}" for k in range(10)]
    assert (merged[0][0].confidence, merged[0][0].value) == ("high", "v3")
    once = fuse.first_wins(facts, ["evidence"])
    assert fuse.first_wins(once.withColumn("seq", F.lit(0)), ["evidence"]).count() == once.count() == 15


def test_evidence_of_a_key_that_all_rows_share(spark):
    facts = spark.range(100_000).selectExpr("IF(id % 1000 = 7, NULL, 'hot') AS key", "id % 3 AS part", "struct(99999 - id AS n) AS seq", "'e' || (id % 5000) AS evidence", "IF(id % 2 = 0, 'low', 'high') AS confidence", "IF(id % 10 = 9, CAST(id AS STRING), NULL) AS value")
    options = {"known": ("value",), "confidence": "confidence", "cap": 10}
    shown = lambda frame: sorted(map(str, frame.select("key", "part", "value", "confidence", "evidence").collect()))
    bounded = fuse.merge_evidence(facts, ["key", "part"], bounded=True, **options)
    assert shown(bounded) == shown(fuse.merge_evidence(facts, ["key", "part"], **options)) and bounded.count() == 6
    assert "WindowGroupLimit" in bounded._jdf.queryExecution().executedPlan().toString()


def test_crawl_stops_at_the_page_limit(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "a"), ("d", "e")], "url string, link string")
    start = spark.createDataFrame([("a",)], "url string")
    assert rows(crawl.reachable(edges, start, max_pages=2), "url", "depth") == [("a", 0), ("b", 1)]
    assert rows(crawl.reachable(edges, start), "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_data_references(spark):
    found = binary.data_references(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (1, None)], "doc_id int, target string"), spark.createDataFrame([(1, "x"), (1, "x"), (1, None)], "doc_id int, addr string"))
    assert sorted((r.doc_id, str(r.target), r.is_string) for r in found.collect()) == [(1, "None", False), (1, "x", True), (1, "x", True), (2, "x", False)]


def test_candidate_edges(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "a", "b")], "doc_id int, caller_addr string, callee_addr string")
    chosen = spark.createDataFrame([(1, "a"), (1, "d")], "doc_id int, addr string")
    plan = binary.candidate_edges(edges, chosen)
    assert rows(plan, "caller_addr", "callee_addr") == [("a", "b"), ("c", "d")]
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_contexts_from_files(spark, tmp_path):
    context = {"binary": "x", "strings": [{"addr": "0x1", "value": "/bin/sh", "xrefs": [{"function_addr": "0x9", "function_name": "handler"}]}], "functions": [{"addr": "0x9", "name": "handler", "size": 8, "string_refs": [{"string_addr": "0x1", "xref_addr": "0xa"}], "import_refs": [{"name": "doSystem"}], "pseudocode": "if (pid < 0) return;"}]}
    (tmp_path / "a.preprocessed.json").write_text(json.dumps(context))
    read = bundles.read_contexts(spark, str(tmp_path))
    assert rows(binary.route_mappings(read), "route", "handler", "confidence") == [("/bin/sh", "handler", "high")]
    assert rows(binary.handlers(read), "name") == [("handler",)] and rows(binary.sinks(read), "api", "category") == [("doSystem", "command")]
    assert rows(binary.constraints(read), "target", "operator", "value") == [("pid", "<", "0")]
    assert rows(binary.candidate_functions(read), "name") == [("handler",)]


def test_bundles_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.json").write_text(json.dumps({"version": "1.0", "input_type": "web_backend_sources", "files": [{"source_file": "a.c", "content": "﻿system(x);"}, {"path": "gone.c"}]}))
    read = bundles.read_bundles(spark, str(tmp_path / "in"))
    source = bundles.sources_of(read, "backend")
    assert rows(source, "source_file", "content") == [("a.c", "system(x);")]
    assert rows(bundles.warnings_of(read, "frontend"), "type") == [("input_type_mismatch",), ("invalid_file",)]
    tables = {"sinks": backend.facts(source, "sinks")}
    document = json.loads(sinks.artifacts(tables, "source_file").first().artifact)
    assert document["sinks"][0]["api"] == "system"
    sinks.write_tables(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/sinks")).count() == 1
    assert sinks.manifest(tables, "source_file").first().facts == 1


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"files": [{"source_file": "a.c", "content": "system(x);" + "\n" * k}]}))
        query = arrivals.merge_stream(arrivals.arriving_sources(spark, str(tmp_path / "in")), lambda s: backend.facts(s, "sinks"), ["source_file", "sink_category", "api"], str(tmp_path / "facts"), str(tmp_path / "cp"))
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "facts/version=1")).count() == 1


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/A.HTM").write_bytes(b"<p>\xffx</p>")
    (tmp_path / "d/b.txt").write_text("no")
    assert [r.content for r in bundles.read_pages(spark, str(tmp_path)).collect()] == ["<p>x</p>"]


def test_binary_headers(spark):
    files = spark.createDataFrame([("a.bin", 9, b"\x7fELF\x02"), ("b.txt", 9, b"\x7fELF\x01"), ("c", 9, b"ab\0c"), ("d.o", 9, b"\x7fELF\x01"), ("e.so", 9, b"text")], "relative_path string, size long, header binary")
    assert rows(bundles.binary_candidates(files, object_files=False), "relative_path", "kind", "bits") == [("a.bin", "elf", 64), ("c", None, None)]


def test_corpora_grow_with_their_tables(spark):
    small, large = (corpora.backend_sources(spark, f"/root/testdata/{x}").count() for x in ("sf0.001", "sf0.01"))
    assert large > 5 * small
