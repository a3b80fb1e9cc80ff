"""Inputs in all their forms, warnings beside facts, and artifact files."""

import json
import random
import re
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factweave.operators import backend, binary, crawl, frontend, htmlevents, ranking, serverconfig
from factweave.sources import artifacts, inputs, sinks


def put(folder: Path, **files: str | bytes) -> None:
    for name, content in files.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def bundle(kind: str, *files: dict, **more) -> str:
    return json.dumps({"version": "1.0", "input_type": inputs.INPUT_TYPES[kind], "files": list(files)} | more)


def shown(frame):
    return [tuple(r) for r in frame.orderBy("input", "entry").collect()]


# --- reading ------------------------------------------------------------------------------------------------------------


def test_pages_below_a_folder(spark, tmp_path):
    put(tmp_path, **{"a.HTM": b"\xef\xbb\xbf<p>\xff\xc3\xa9</p>", "sub__b.asp": "B", "c.txt": "no", "d.php": ""})
    rows = shown(inputs.read_inputs(spark, "frontend", str(tmp_path)))
    assert [(Path(r[0]).name, r[1], r[3], r[4]) for r in rows] == [("a.HTM", 0, "<p>é</p>", None), ("d.php", 0, "", None), ("b.asp", 0, "B", None)]
    assert all(r[0] == r[2] for r in rows)


def test_one_page_a_bundle_and_the_dispatch_between_them(spark, tmp_path):
    put(tmp_path, page__htm="x", **{"page.htm": "P", "other.txt": "no"})
    given = bundle("frontend", {"source_file": "inline.htm", "content": 5}, {"content": "nameless"}, {"path": str(tmp_path / "page.htm")}, {"source_file": str(tmp_path / "other.txt")}, {"source_file": str(tmp_path / "gone.htm")}, {"content": None}, "no object")
    put(tmp_path, **{"b.json": given})
    assert [r[2:] for r in shown(inputs.read_inputs(spark, "frontend", str(tmp_path / "page.htm")))] == [(str(tmp_path / "page.htm"), "P", None, None)]
    expected = [(0, "inline.htm", "5"), (1, "<inline>", "nameless"), (2, str(tmp_path / "page.htm"), "P")]
    for form in ("auto", "json"):
        assert [r[1:4] for r in shown(inputs.read_inputs(spark, "frontend", str(tmp_path / "b.json"), format=form))] == expected
    assert shown(inputs.read_inputs(spark, "frontend", str(tmp_path / "b.json"), format="path")) == []
    with pytest.raises(Exception, match="no such input"):
        inputs.read_inputs(spark, "frontend", str(tmp_path / "gone")).collect()
    with pytest.raises(Exception, match="unknown kind"):
        inputs.read_inputs(spark, "odd", str(tmp_path)).collect()


def test_default_places(spark, tmp_path):
    name = "output/web_json/{}/web_backend_sources.readable.json"
    for folder in ("z", "a"):
        put(tmp_path, **{f"collector/{name.format(folder)}": bundle("backend", {"source_file": folder, "content": "x"})})
    read = lambda kind, **more: [r[2] for r in shown(inputs.read_inputs(spark, kind, root=str(tmp_path), **more))]
    assert read("backend") == ["a", "z"]
    put(tmp_path, **{name.format("m"): bundle("backend", {"source_file": "m", "content": "x"}), "deep/" + name.format("n"): bundle("backend")})
    assert read("backend") == ["m"]  # the other place is for want of this one
    assert read("backend", glob="collector/output/web_json/z*/*.json") == ["z"]
    with pytest.raises(Exception, match="no inputs below"):
        read("backend", glob="nothing/*.json")
    assert read("config") == []  # no error there
    both = {f"{place}output/web_json/{k}/web_server_config_sources.readable.json": bundle("config", {"source_file": k, "content": "x"}) for k, place in (("one", ""), ("two", "collector/"))}
    put(tmp_path, **both)
    assert sorted(read("config")) == ["one", "two"]


def test_contexts(spark, tmp_path):
    with pytest.raises(Exception, match="no .*preprocessed.json below"):
        inputs.read_inputs(spark, "contexts", str(tmp_path)).collect()
    put(tmp_path, **{"x/b.preprocessed.json": "\ufeff" + json.dumps({"binary": "b"}), "a.json": "{}"})
    (row,) = shown(inputs.read_inputs(spark, "contexts", str(tmp_path)))
    assert json.loads(row[3]) == {"binary": "b"}


def test_partitions_hold_so_many_bytes(tmp_path):
    put(tmp_path, **{f"p{k:02}.htm": "x" * 10 for k in range(20)}, **{"big.htm": "y" * 500})
    reader = inputs.InputReader({"path": str(tmp_path), "partitionBytes": "50"})
    parts = [p.files for p in reader.partitions()]
    assert [len(p) for p in parts] == [1, 5, 5, 5, 5] and sum(parts, []) == sorted(sum(parts, []))


WRONG = {
    "cut.json": ("invalid_json", '{"files": ['), "list.json": ("invalid_json", "[1]"), "type.json": ("unexpected_input_type", bundle("frontend", {"source_file": "t.c", "content": "reboot();"})),
    "files.json": ("invalid_files", json.dumps({"input_type": "web_backend_sources", "files": {}})), "entry.json": ("invalid_file_entry", bundle("backend", {"source_file": "e.c", "content": 1}, 7, {"source_file": "f.c", "content": "reboot();"})),
}


def test_one_bad_input_costs_no_others(spark, tmp_path):
    good = {f"g{k:03}.json": bundle("backend", {"source_file": f"{k}.c", "content": f"system(a{k});\nreboot();"}) for k in range(200)}
    put(tmp_path, **good, **{name: text for name, (_, text) in WRONG.items()})
    by_file = inputs.read_inputs(spark, "backend", str(tmp_path))
    texts = spark.createDataFrame([(str(tmp_path / n), t) for n, t in (good | {n: t for n, (_, t) in WRONG.items()}).items()], "input string, content string")
    for parsed in (by_file, inputs.parsed_bundles(texts, "backend")):
        sources, warnings = inputs.parted(parsed)
        found = sorted((Path(r.input).name, r.entry, r.warning) for r in warnings.collect())
        assert found == sorted([("cut.json", -1, "invalid_json"), ("list.json", -1, "invalid_json"), ("type.json", -1, "unexpected_input_type"), ("files.json", -1, "invalid_files"), ("entry.json", 0, "invalid_file_entry"), ("entry.json", 1, "invalid_file_entry")])
        assert backend.facts(sources.select("source_file", "content"), "sinks").count() == 2 * 200 + 2
    config = inputs.parsed_bundles(texts.where(F.col("input").endswith("type.json")), "config").collect()
    assert [(r.warning, r.content) for r in config] == [("unexpected_input_type", None)]


def test_one_bad_page_costs_no_others(spark):
    pages = spark.createDataFrame([(f"p{k}", f"<form action=/a{k}.cgi></form>" + "<![foo[" * (k == 7)) for k in range(50)] + [("empty", None)], "source_file string, content string")
    events = htmlevents.html_events(pages).cache()
    assert [r.source_file for r in htmlevents.parse_warnings(events).collect()] == ["p7"]
    found = {r.source_file for r in frontend.routes(pages.where("source_file <> 'p7'"), events).collect()}
    assert found == {f"p{k}" for k in range(50)} - {"p7"}


# --- writing ------------------------------------------------------------------------------------------------------------


def documents(folder: Path) -> dict[str, dict]:
    return {str(p.relative_to(folder)): json.loads(p.read_text()) for p in folder.rglob("*.json")}


def test_backend_artifacts(spark, tmp_path):
    for k in "ab":
        put(tmp_path, **{f"in/{k}/web_backend_sources.readable.json": bundle("backend", {"source_file": "same.c", "content": f'puts("é{k}xyz");\nsystem(x);\n'}, {"source_file": 1})})
    put(tmp_path, **{"in/c/x.json": "broken"})
    parsed = inputs.read_inputs(spark, "backend", str(tmp_path / "in"))
    artifacts.backend_layout(parsed).write(spark, str(tmp_path / "out"))
    found = documents(tmp_path / "out")
    assert set(found) == {"a.web_backend_sources.artifacts.json", "b.web_backend_sources.artifacts.json", "c.x.json.artifacts.json", "manifest.json"}
    one = found["a.web_backend_sources.artifacts.json"]
    assert list(one)[:6] == ["version", "input_type", "artifact_type", "source_count", "files", "handlers"] and list(one)[-2:] == ["parse_warnings", "summary"]
    assert one["files"] == [{"source_file": "same.c", "line_count": 2, "counts": {"sinks": 1, "strings": 1}}]
    assert one["sinks"] == [{"sink_category": "command", "api": "system", "source_file": "same.c", "evidence": {"source_file": "same.c", "line": 2, "snippet": "system(x);"}}]
    assert one["strings"][0]["string"] == "éaxyz" and one["handlers"] == []
    assert one["summary"] == {"parsed_files": 1, "skipped_files": 1, "total_files_in_input": 2, "counts": {"sinks": 1, "strings": 1}}
    assert found["c.x.json.artifacts.json"]["parse_warnings"][0]["type"] == "invalid_json"
    manifest = found["manifest.json"]
    assert manifest["produced_count"] == 3 and [Path(r["output"]).name for r in manifest["results"]] == sorted(set(found) - {"manifest.json"})
    text = (tmp_path / "out/a.web_backend_sources.artifacts.json").read_text()
    assert text == json.dumps(one, ensure_ascii=False, indent=2)
    single = parsed.where(F.col("input").contains("/a/"))
    artifacts.backend_layout(single).write(spark, str(tmp_path / "alone/one.json"))
    assert documents(tmp_path / "alone") == {"one.json": one}


def test_config_and_page_artifacts(spark, tmp_path):
    put(tmp_path, **{"dev1/c.json": bundle("config", {"source_file": "boa.conf", "content": "Port 81\nDocumentRoot /www\n"}), "dev2/c.json": bundle("frontend")})
    artifacts.config_layout(inputs.read_inputs(spark, "config", str(tmp_path))).write(spark, str(tmp_path / "out"))
    found = documents(tmp_path / "out")
    one, two = (found[f"dev{k}.web_server_config_artifacts.json"] for k in (1, 2))
    assert [x["port"] for x in one["listeners"]] == [81] == one["summary"]["listener_ports"]
    assert one["summary"]["server_types"] == ["boa"] and one["summary"]["listeners_count"] == 1 and one["source_input"].endswith("dev1/c.json")
    assert two["servers"] == [] and len(two["parse_warnings"]) == 1 == two["summary"]["parse_warnings_count"] and two["summary"]["server_types"] == []
    put(tmp_path, **{"www/a.htm": "<title>A</title><form action=/x.cgi></form>", "www/b.htm": ""})
    layout = artifacts.frontend_layout(inputs.read_inputs(spark, "frontend", str(tmp_path / "www")))
    layout.write(spark, str(tmp_path / "pages"))
    single = documents(tmp_path / "pages")
    assert sorted(re.sub("_[0-9a-f]{10}[.]", ".", n)[-35:] for n in single) == [f"www_{x}.htm.web_frontend_artifacts.json"[-35:] for x in "ab"]
    layout.write(spark, str(tmp_path / "array/all.json"))
    (pages,) = documents(tmp_path / "array").values()
    assert [Path(p["source_file"]).name for p in pages] == ["a.htm", "b.htm"] and pages[0]["routes"][0]["url"] == "/x.cgi" and pages[1]["routes"] == []
    assert pages == [single[n] for n in sorted(single, key=lambda n: single[n]["source_file"])]
    assert (tmp_path / "array/all.json").read_text() == json.dumps(pages, ensure_ascii=False, indent=2)


def pieces(spark, rows):
    return spark.createDataFrame(rows, "input string, section_no int, seq long, item string").repartition("input").sortWithinPartitions("input", "section_no", "seq")


def save(spark, rows, target, layout="binary", sections=(("binary", False), ("routes", True), ("summary", False))):
    spark.dataSource.register(artifacts.Artifacts)
    rows.write.format("fact_artifacts").option("layout", layout).option("sections", json.dumps(sections)).mode("append").save(str(target))


def test_binary_artifacts_and_their_summary(spark, tmp_path):
    rows = [(f"/in/{k}.preprocessed.json", 0, 0, json.dumps({"source_file": k})) for k in ("x", "y")] + [("/in/x.preprocessed.json", 1, s, str(s)) for s in range(3)] + [("/in/y.preprocessed.json", 2, 0, '{"route_count": 4}')]
    save(spark, pieces(spark, rows), tmp_path)
    found = documents(tmp_path)
    assert found["x.web_backend_binary_artifacts.json"] == {"binary": {"source_file": "x"}, "routes": [0, 1, 2], "summary": None}
    status = found["status_summary.json"]
    assert (status["total"], status["ok"], status["non_ok"]) == (2, 2, 0) and [(r["binary"], r["route_count"]) for r in status["results"]] == [("x", None), ("y", 4)]


def test_failed_jobs_leave_nothing(spark, tmp_path):
    good = [(f"/in/{k}/f.readable.json", 0, 0, "1") for k in range(6)]
    sections = (("version", False),)
    with pytest.raises(Exception):
        save(spark, pieces(spark, [*good, ("/in/bad/f.readable.json", 0, 0, "no json")]), tmp_path, "backend", sections)
    assert documents(tmp_path) == {}
    with pytest.raises(Exception, match="one place"):
        save(spark, pieces(spark, [*good, ("/elsewhere/3/f.readable.json", 0, 0, "1")]), tmp_path, "backend", sections)
    assert documents(tmp_path) == {}
    save(spark, pieces(spark, good), tmp_path, "backend", sections)
    assert len(documents(tmp_path)) == 7 and not list((tmp_path / artifacts.STAGING).iterdir())


def test_a_killed_task_is_not_in_the_manifest(tmp_path):
    from pyspark.sql import Row

    options = {"layout": "backend", "path": str(tmp_path), "sections": json.dumps([("version", False)])}
    writer = artifacts.ArtifactWriter(options, False)
    rows = lambda k: iter([Row(input=f"/in/{k}/f.readable.json", section_no=0, seq=0, item="1")])

    def cut_off():
        yield from rows("lost")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(cut_off())
    again, other = writer.write(rows("lost")), writer.write(rows("b"))
    writer.write(rows("lost"))  # a second attempt whose message nobody takes
    writer.commit([again, None, other])
    found = documents(tmp_path)
    assert [Path(r["input"]).parent.name for r in found["manifest.json"]["results"]] == ["b", "lost"] and len(found) == 3


def test_what_a_crawl_leaves(spark, tmp_path):
    pages = [("http://h/a.asp", "<title>A</title><a href=b.asp></a><script src=s.js></script><form action=/go.cgi method=post id=f><input name=x type=text value=1></form>", 200), ("http://h/b.asp", "", None)]
    sinks.write_crawl(spark.createDataFrame(pages, "url string, html string, status_code int"), str(tmp_path), "http://h/")
    lines = lambda name: sorted((json.loads(x) for p in (tmp_path / name).glob("*.json") for x in p.read_text().splitlines()), key=str)
    one, two = sorted(lines("pages"), key=lambda r: r["url"])
    assert (one["title"], one["links"], one["scripts"], one["status_code"], len(one["forms"])) == ("A", ["http://h/b.asp", "http://h/s.js"], ["http://h/s.js"], 200, 1)
    assert (two["title"], two["links"], two["forms"], two["status_code"], two["content_type"]) == ("", [], [], None, None)
    (template,) = lines("seed_templates")
    assert list(template) == ["kind", "target", "method", "risky", "source_page", "form_id", "seed_values"] and template["seed_values"] == {"x": "1"} and template["kind"] == "form_template"
    (summary,) = lines("summary")
    assert (summary["page_count"], summary["endpoint_count"], summary["form_template_count"]) == (2, 3, 1) and summary["generated_at"] > 1_000_000_000
    (report,) = (tmp_path / "report").glob("*.txt")
    assert report.read_text().splitlines() == ["Base URL: http://h/", "Proxy URL: ", "Pages crawled: 2", "Endpoints discovered: 3", "Form templates: 1", "", "Top endpoints:", "- GET /a.asp", "- GET /b.asp", "- POST /go.cgi risky"]


# --- crawl order, ranges, caps -----------------------------------------------------------------------------------------------


def plain_queue(links, start, most=None):
    queue, taken = deque(start), {}
    depth = dict.fromkeys(start, 0)
    while queue and (most is None or len(taken) < most):
        page = queue.popleft()
        if page in taken:
            continue
        taken[page] = len(taken)
        for link in links.get(page, []):
            depth.setdefault(link, depth[page] + 1)
            if link not in taken:
                queue.append(link)
    return sorted((p, depth[p], n) for p, n in taken.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_visits_are_those_of_a_queue(spark, seed):
    rng = random.Random(seed)
    links = {p: [rng.randrange(60) for _ in range(rng.randrange(5))] for p in range(50)}
    edges = spark.createDataFrame([(p, k, x) for p, own in links.items() for k, x in enumerate(own)], "url long, pos int, link long").repartition(3)
    start = [rng.randrange(50) for _ in range(3)]
    first = spark.createDataFrame([(s, k) for k, s in enumerate(start)], "url long, pos int")
    whole = plain_queue(links, start)
    for most in (None, 1, len(whole) // 2, len(whole)):
        assert sorted(map(tuple, crawl.visits(edges, first, most).collect())) == plain_queue(links, start, most)


def test_a_long_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "url long, link long")
    start = spark.createDataFrame([(0,)], "url long")
    assert sorted(map(tuple, crawl.reachable(edges, start).collect())) == [(k, k) for k in range(31)]
    assert sorted(map(tuple, crawl.reachable(edges, start, max_depth=3).collect())) == [(k, k) for k in range(4)]


def test_numbers(spark):
    rows = spark.createDataFrame([(x, str(x)) for x in random.Random(1).sample(range(1000), 300)], "x long, y string").repartition(5)
    found = sorted((r.n, r.x) for r in ranking.numbered(rows, ["x"], "n").collect())
    assert [n for n, _ in found] == list(range(300)) and [x for _, x in found] == sorted(x for _, x in found)


def test_containing_functions_at_any_width(spark):
    rng = random.Random(4)
    ranges = [(d, f"f{k}", a, a + w) for k, (d, a, w) in enumerate((rng.randrange(2), rng.randrange(2**20), rng.choice([0, 1, 2, 3, 4, 5, 16, 17, 4096, 70_000, 2**19])) for _ in range(120))]
    ranges += [(0, "all", 0, 2**62), (0, "most", 5, 2**40), (1, "last", 2**62 - 9, 2**62)]
    points = [(rng.randrange(2), rng.choice([rng.randrange(2**20), a, b - 1, b])) for _, _, a, b in ranges for _ in range(4)]
    points = sorted({(d, max(x, 0)) for d, x in points})
    found = binary.functions_at(spark.createDataFrame(points, "doc_id int, ea long"), spark.createDataFrame(ranges, "doc_id int, name string, start long, stop long"))
    expected = sorted((d, x, n) for d, x in points for e, n, a, b in ranges if d == e and a <= x < b)
    assert sorted((r.doc_id, r.ea, r.name) for r in found.collect()) == expected


def test_ranges_meet_only_the_addresses_they_hold(spark):
    rng = random.Random(5)
    ends = [(a, a + w) for a, w in ((rng.randrange(-(2**30), 2**30), rng.choice([1, 2, 3, 5, 6, 7, 63, 64, 1000, 2**20 + 1, 2**40])) for _ in range(60))]
    ends += [(-(2**63), 2**63 - 1), (-(2**63), -(2**63) + 1), (2**63 - 2, 2**63 - 1), (-(2**62), 2**62), (7, 7), (9, 3), (-5, 2**62 + 5)]
    ranges = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate(ends)], "doc_id int, name long, start long, stop long")
    points = sorted({min(max(x, -(2**63)), 2**63 - 1) for a, b in ends for x in (a - 1, a, (a + b) // 2, b - 1, b)})
    places = {}
    for r in binary.cells_of(ranges).collect():
        places.setdefault(r.name, []).append((r.cell << 2 * r.level, (r.cell + 1) << 2 * r.level))
    for name, (a, b) in enumerate(ends):
        cells = sorted(places.get(name, []))
        assert len(cells) <= 6 * 32 and all(x[1] == y[0] for x, y in zip(cells, cells[1:], strict=False))
        assert (cells[0][0], cells[-1][1]) == (a, b) if a < b else not cells
    addresses = spark.createDataFrame([(0, x, k) for k, x in enumerate(points)] + [(1, 0, -1)], "doc_id int, ea long, key long")
    pairs = sorted((k, n) for k, x in enumerate(points) for n, (a, b) in enumerate(ends) if a <= x < b)
    assert sorted((r.key, r.name) for r in binary.functions_at(addresses, ranges).collect()) == pairs
    found = binary.totals_at(addresses, ranges, {"n": F.lit(1), "names": F.col("name")}, {"first": F.col("name")})
    expected = {k: [n for j, n in pairs if j == k] for k, _ in pairs}
    assert {r.key: (r.n, r.names, r.first) for r in found.collect()} == {k: (len(v), sum(v), min(v)) for k, v in expected.items()}


def plain_edges(calls, candidates, cap):
    """Function by function, by address; a function is walked through once for each candidate address in it."""
    seen, out = set(), []
    for doc, _, function in sorted(candidates):
        count = 0
        for _, callee in sorted(x for d, f, *x in calls if d == doc and f == function):
            if (doc, function, callee) in seen:
                continue
            seen.add((doc, function, callee))
            out.append((doc, function, callee))
            count += 1
            if count >= cap:
                break
    return sorted(out)


def test_edges_in_order_of_discovery(spark):
    rng = random.Random(6)
    calls = [(rng.randrange(2), rng.randrange(12), site, rng.randrange(30)) for site in range(600)]
    candidates = sorted({(rng.randrange(2), ea, ea // 10) for ea in rng.sample(range(120), 30)})
    frame = spark.createDataFrame(calls, "doc_id int, caller_addr int, site int, callee_addr int")
    visits = spark.createDataFrame([(d, f) for d, _, f in candidates], "doc_id int, addr int")
    found = binary.call_edges(frame, 4, visits)
    assert sorted((r.doc_id, r.caller_addr, r.callee_addr) for r in found.collect()) == plain_edges(calls, candidates, 4)
    assert "WindowGroupLimit" in binary.call_edges(frame, 4)._jdf.queryExecution().executedPlan().toString()
