"""Stated cases of discovery, robots, contexts, recognition, pacing, progress, storage, clients and scaffolding."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from storeloom.functions import jsonx as J
from storeloom.functions import numbers as N
from storeloom.functions import text as T
from storeloom.operators import artifacts as A
from storeloom.operators import catalogue, discovery, observe, ocr, platforms, robots, scaffold
from storeloom.sources import http, model_client, recogniser, storage
from storeloom.streaming import pacing, progress


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


# --- discovery


def candidates(spark, rows):
    return discovery.in_memory(spark, rows)


def test_candidates(spark):
    rows = [("https://x/p/b", "b"), ("https://x/p/a", "a")]
    got = discovery.load_candidates(candidates(spark, rows)).orderBy("pos").collect()
    assert [(r.url, r.product_id) for r in got] == rows
    with pytest.raises(discovery.CandidatesNotFound) as e:
        discovery.load_candidates(candidates(spark, rows).where("pos > 9"), "example", "2026-Q3")
    assert (e.value.source, e.value.quarter) == ("example", "2026-Q3")
    for bad, index, field in (([(None, "1")], 0, "productUrl"), ([("", "1")], 0, "productUrl"), ([rows[0], ("u", None)], 1, "productId"), ([("", None)], 0, "productUrl")):
        with pytest.raises(discovery.InvalidCandidate) as e:
            discovery.load_candidates(candidates(spark, bad))
        assert (e.value.index, e.value.field) == (index, field)


def test_candidate_data_source(spark):
    from storeloom.sources.candidates import CandidateSource

    spark.dataSource.register(CandidateSource)
    got = spark.read.format("storeloom_candidates").option("rows", json.dumps([["u", "1"], ["v", "2"]])).load().orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, "u", "1"), (1, "v", "2")]


def index(*locs):
    return "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in locs) + "</sitemapindex>"


def pages(*locs):
    return "<urlset>" + "".join(f"<loc>{x}</loc>" for x in locs) + "</urlset>"


def walk(spark, maps):
    got = discovery.walk_sitemaps(spark.createDataFrame(maps, "url string, xml string"), "r")
    return [r.url for r in got.orderBy("pos").collect()]


def test_walk(spark):
    assert walk(spark, [("r", pages("a", "b", "a"))]) == ["a", "b"]
    assert set(walk(spark, [("r", index("s1", "s2")), ("s1", index("t")), ("s2", pages("b")), ("t", pages("a", "b"))])) == {"a", "b"}
    assert set(walk(spark, [("r", index("s", "r")), ("s", index("r", "t")), ("t", pages("a"))])) == {"a"}
    with pytest.raises(discovery.SitemapTooDeep):
        walk(spark, [("r", index("1")), ("1", index("2")), ("2", index("3")), ("3", pages("a"))])


def test_slugs(spark):
    urls = spark.createDataFrame([("https://h/p/a%20b+c",), ("https://h/x",), ("https://h/p/",)], "url string")
    assert [r.product_id for r in discovery.product_candidates(urls, "/p/([^/?#]+)").collect()] == ["a b+c"]
    bad = spark.createDataFrame([("https://h/p/%zz",)], "url string")
    with pytest.raises(Exception, match="(?i)url"):
        discovery.product_candidates(bad, "/p/([^/?#]+)").collect()
    assert discovery.product_candidates(bad, "/p/([^/?#]+)", strict=False).count() == 0


# --- robots


def parse_fold(text):
    out, wild, collecting = [], False, False
    for line in text.replace("\r\n", "\n").split("\n"):
        line = line.split("#")[0].strip()
        key, sep, value = line.partition(":")
        if not sep or not key:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            wild, collecting = (wild if collecting else False) or value == "*", True
        elif key == "sitemap":
            if value:
                out.append(("sitemap", value))
        else:
            collecting = False
            hard = "*" in value[:-1] or value.endswith("$")
            if wild and value and key in ("allow", "disallow") and not (key == "allow" and hard):
                out.append(("unsupported" if hard else key, value))
    return out


def test_robots_parse_equals_fold(spark):
    rng = random.Random(5)
    lines = ["User-agent: *", "user-agent: x", "Disallow: /a", "Disallow:", "Allow: /a/b # c", "Allow: /*.js$", "Disallow: /*.json$", "Disallow: /foo$", "", "Sitemap: https://s", "Crawl-delay: 2", "nonsense", ": x", "Disallow: /z*"]
    files = [(f"h{i}", rng.choice(["\n", "\r\n"]).join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(150)]
    got = robots.parse(spark.createDataFrame(files, "host string, text string")).orderBy("host", "line").collect()
    by_host = {h: [(r.kind, r.pattern) for r in rs] for h, rs in itertools.groupby(got, key=lambda r: r.host)}
    for host, text in files:
        assert by_host.get(host, []) == parse_fold(text), text


def test_disallowed_equals_loop(spark):
    rng = random.Random(6)
    rules = [(f"h{i}", rng.choice(["allow", "disallow", "unsupported"]), "/" + "".join(rng.choice("ab*") for _ in range(rng.randint(0, 4))) + rng.choice(["", "$", "*"])) for i in range(40) for _ in range(rng.randint(0, 5))]
    paths = list({(f"h{i}", "/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for i in range(42) for _ in range(6)})
    frame = spark.createDataFrame(rules, "host string, kind string, pattern string")
    got = {(r.host, r.path): r.disallowed for r in robots.disallowed(spark.createDataFrame(paths, "host string, path string"), frame).collect()}
    for host, path in paths:
        mine = [(k, p) for h, k, p in rules if h == host and path.startswith(p.split("*")[0])]
        deny = max([len(p) for k, p in mine if k != "allow"], default=0)
        allow = max([len(p) for k, p in mine if k == "allow"], default=0)
        assert got[host, path] == (deny > allow)


def test_dollar_rules(spark):
    rules = spark.createDataFrame([("h", "unsupported", "/foo$")], "host string, kind string, pattern string")
    paths = spark.createDataFrame([("h", "/foo")], "host string, path string")
    assert not robots.disallowed(paths, rules).first().disallowed
    assert robots.disallowed(paths, rules, strict=True).first().disallowed


# --- contexts


V = A.Vocabulary(roles=(*A.BASE_ROLES, "datasheet"), preferences={"specs": ("html", "datasheet")})


def project(spark, classified, head=("p", "role-filtered", None), kinds=("image", "image"), projection="specs"):
    arts = spark.createDataFrame([(1, i, name, kind, "x" * (i + 1)) for i, (name, kind) in enumerate(zip("ab", kinds))], "page_id int, pos int, id string, artifact_kind string, raw_markdown string")
    heads = spark.createDataFrame([(1, *head)] if head else [], "page_id int, provider_name string, selection_mode string, provider_reason string")
    cls = spark.createDataFrame([(1, i, n, r, None) for i, (n, r) in enumerate(classified)], "page_id int, pos int, id string, roles array<string>, reason string")
    summary, detail = A.project(arts, heads, cls, projection, V)
    return summary.first(), sorted(r.id for r in detail.collect()), (summary, detail)


def test_projection_outcomes(spark):
    s, ids, _ = project(spark, [("a", ["datasheet"]), ("b", ["promo"])])
    assert (s.selected, s.dropped, s.fallback_reason, ids, s.chars_before, s.chars_after) == (1, 1, None, ["a"], 3, 1)
    s, ids, _ = project(spark, [], head=None, kinds=("html", "image"))
    assert (s.fallback_reason, s.provider_name, ids) == ("NO_PROVIDER", "default", ["a", "b"])
    s, ids, _ = project(spark, [("a", ["datasheet"])], projection="other")
    assert (s.fallback_reason, ids) == (None, ["a", "b"])
    s, ids, _ = project(spark, [("a", ["certificate"])])
    assert (s.fallback_reason, ids) == ("NO_SELECTED_ARTIFACTS", ["a", "b"])
    s, ids, _ = project(spark, [("a", ["html", "promo"]), ("b", ["certificate"])])
    assert (s.fallback_reason, ids) == (None, ["a"])
    s, ids, _ = project(spark, [("a", ["html"]), ("b", ["unknown"])])
    assert (s.fallback_reason, ids) == ("CLASSIFICATION_EMPTY", ["a", "b"])
    s, ids, _ = project(spark, [("a", ["datasheet"])], head=("p", "role-filtered", "partial"))
    assert (s.fallback_reason, s.provider_reason, ids) == ("PROVIDER_FALLBACK", "partial", ["a"])
    s, ids, _ = project(spark, [("a", ["datasheet"]), ("b", ["promo"]), ("zz", ["datasheet"]), ("yy", ["html"])])
    assert (s.selected, s.dropped) == (3, -1)


def test_last_classification_wins(spark):
    _, _, (_, detail) = project(spark, [("a", ["promo"]), ("a", ["certificate"])], head=("p", "full", None))
    assert {r.id: r.roles for r in detail.collect()} == {"a": ["certificate"], "b": ["unknown"]}


def test_with_roles(spark):
    *_, (summary, detail) = project(spark, [("a", ["datasheet"]), ("b", ["html"])])
    assert [r.id for r in A.with_roles(detail, summary, ["datasheet"]).collect()] == ["a"]
    assert A.with_roles(detail, summary, ["promo"]).count() == 0
    *_, (summary, detail) = project(spark, [], head=None)
    assert A.with_roles(detail, summary, ["promo"]).count() == 2


def test_vocabulary():
    assert A.Vocabulary().noise == ("related-product", "promo", "ui")
    for more in ({"structural": "x"}, {"unknown": "x"}, {"noise": ("x",)}, {"preferences": {"p": ("x",)}}):
        with pytest.raises(A.VocabularyError):
            A.Vocabulary(**more)


# --- recognition and JSON


def test_bands(spark):
    for value, band in ((None, "LOW"), (0.9, "HIGH"), (0.82, "HIGH"), (0.7, "MEDIUM"), (0.55, "MEDIUM"), (0.2, "LOW")):
        assert one(spark, value, N.confidence_band, "double") == band
    assert one(spark, 0.94, lambda c: N.confidence_band(c, 0.95, 0.9), "double") == "MEDIUM"
    assert one(spark, 1.0005, N.three_decimals, "double") == 1.0


def test_confusions(spark):
    check = lambda *xs: one(spark, list(xs), ocr.confusion_check, "array<string>")
    assert check("黄者 萃取物") == ["suspect_黃耆_as_黄者"]
    assert check("黃耆") == []
    both = one(spark, ["黃蓍"], lambda c: ocr.run_checks(c, [ocr.confusion_check, lambda x: F.array(F.lit("w"))]), "array<string>")
    assert both == ["suspect_黃耆_as_黃蓍", "w"]


def test_layout_boxes(spark):
    line = lambda box: {"text": "t", "confidence": 0.5, "boundingBox": box}
    good = {"x": 0, "y": 0, "width": 1, "height": 1}
    boxes = [good, {**good, "width": 0}, {**good, "x": -0.1}, {**good, "x": 0.5}, {"x": 0}, 7]
    doc = {"provider": "p", "coordinateSystem": "normalized-lower-left", "lines": [*map(line, boxes), {"text": "n", "confidence": "1"}, 3]}
    got = one(spark, json.dumps(doc), J.layout)
    assert [x.bounding_box is not None for x in got.lines] == [True, False, False, False, False, False]
    for broken in ("{", "[]", "{}", json.dumps({**doc, "provider": 1}), json.dumps({**doc, "lines": []}), json.dumps({**doc, "coordinateSystem": "px"})):
        assert one(spark, broken, J.layout) is None


def test_fences_and_trim(spark):
    assert one(spark, ' ```json\n{"a":1}\n``` ', T.without_fences) == '{"a":1}'
    assert one(spark, "no fence", T.without_fences) == "no fence"
    assert one(spark, "﻿ 　a b \n", T.trim_spaces) == "a b"
    assert one(spark, "a\U0001f600", T.utf16_length) == 3


def test_transcribe(spark):
    rows = spark.createDataFrame([(1, b"ok", "image/png"), (2, b"bad", "image/png")], "id long, content binary, mime_type string")

    def engine(content, mime):
        if content == b"bad":
            raise RuntimeError("no")
        return '{"ok":true,"lines":[{"text":"a","confidence":0.9}]}'

    got = {r.id: r.result for r in recogniser.transcribe(rows, lambda: engine).collect()}
    assert got[1].raw_markdown == "a" and got[1].confidence == "HIGH"
    assert got[2].fallback_reason == "PROVIDER_ERROR" and got[2].notes == "RuntimeError: no"


# --- pacing, progress, storage


def pacing_fold(times, interval):
    free, out = -(1 << 60), []
    for t in times:
        slot = max(t, free)
        out.append(slot)
        free = slot + interval
    return out


def test_schedule_equals_fold(spark):
    rng = random.Random(8)
    rows = [(h, i, rng.randint(0, 300)) for h in range(20) for i in range(rng.randint(1, 30))]
    got = pacing.schedule(spark.createDataFrame(rows, "host_id long, seq long, t_us long"), 17).orderBy("host_id", "seq").collect()
    for host, mine in itertools.groupby(got, key=lambda r: r.host_id):
        mine = list(mine)
        assert [r.slot for r in mine] == pacing_fold([r.t_us for r in mine], 17)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(h, i, i * 10 + rng.randint(0, 9)) for h in range(5) for i in range(20)]
    frame = spark.createDataFrame(rows, "host_id long, seq long, t_us long")
    for k in range(2):
        frame.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pacing.pace_stream(stream, 25).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.host_id, r.seq): r.slot for r in pacing.schedule(frame, 25).collect()}
    assert {(r.host_id, r.seq): r.slot for r in spark.table("paced").collect()} == want


def test_progress(tmp_path):
    told, now = [], iter([0.0, 1.0, 2.0, 4.0, 5.0])
    t = progress.Tracker("p", "stage", 8, clock=lambda: next(now), write=lambda path, x: told.append(x))
    t.start()
    t.update(2, stats={"a": 1})
    t.done({"b": 2})
    assert [(x["status"], x["percentage"], x["etaSeconds"]) for x in told] == [("start", 0, 0), ("running", 25.0, 6), ("done", 100, 0)]
    assert told[-1]["stats"] == {"a": 1, "b": 2} and told[-1]["finishedAt"].endswith("Z")
    progress.write_progress(str(tmp_path / "no" / "dir.json"), {})
    progress.write_progress(str(tmp_path / "x.json"), {"a": 1})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 1\n}\n'


def test_first_stored(spark):
    stored = spark.createDataFrame([("b/1", "B"), ("c/1", "C")], "path string, html string")
    wanted = spark.createDataFrame([("1", ["a/1", "b/1", "c/1"]), ("2", ["x"])], "product_id string, paths array<string>")
    assert [(r.product_id, r.path, r.html) for r in storage.first_stored(wanted, stored).orderBy("product_id").collect()] == [("1", "b/1", "B"), ("2", None, None)]
    with pytest.raises(storage.ProductHtmlNotFound) as e:
        storage.read_product_html(wanted, stored)
    assert e.value.attempted == ["x"]


# --- HTTP and model clients


def make_transport():
    # a closure, so that workers get it by value
    def transport(url, headers, timeout):
        if "abort" in url:
            raise TimeoutError
        if "down" in url:
            raise OSError("refused")
        if "missing" in url:
            return 404, {}, b""
        return 200, {"Content-Type": "image/webp"}, b"body"

    return transport


transport = make_transport()


def test_fetch(spark):
    urls = spark.createDataFrame([(f"https://h.test/{x}",) for x in ("ok", "abort", "down", "missing")], "url string")
    got = {r.url.rsplit("/")[-1]: (r.status, r.text, r.error_code) for r in http.fetch_text(urls, transport, interval_ms=0).collect()}
    assert got == {"ok": (200, "body", None), "abort": (None, None, "FETCH_ABORTED"), "down": (None, None, "FETCH_FAILED"), "missing": (404, None, "HTTP_STATUS")}
    images = {r.url.rsplit("/")[-1]: (r.base64, r.mime_type, r.error_code) for r in http.fetch_images(urls, transport, interval_ms=0).collect()}
    assert images["ok"] == ("Ym9keQ==", "image/webp", None) and images["missing"][2] == "HTTP_NOT_OK" and images["abort"][2] == "FETCH_FAILED"


def test_pacing_within_a_task():
    import pandas as pd

    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    run = http.paced(transport, {}, 1, 2000, clock=lambda: now[0], sleep=sleep)
    list(run(iter([pd.DataFrame({"url": ["a", "b", "c"], "host": ["x", "x", "y"]})])))
    assert slept == [2.0]


def test_model_client():
    def client(*answers):
        left = iter(answers)

        def call(model, messages, timeout):
            a = next(left)
            if isinstance(a, Exception):
                raise a
            return a, {"total_tokens": 5}

        return call

    ask = lambda *answers, check=None: model_client.ask(client(*answers), "m", "p", None, None, check)
    assert ask("hi")["content"] == "hi"
    assert (ask("", "", "")["error_code"], ask("", "x")["attempts"]) == ("EMPTY_RESPONSE", 2)
    got = ask("no json", '```json\n{"a": 1}\n```', check=lambda v: "a" in v)
    assert (got["content"], got["attempts"], got["total_tokens"]) == ('{"a": 1}', 2, 10)
    assert ask("[]", "[]", "[]", check=lambda v: False)["error_code"] == "INVALID_OUTPUT"
    assert ask(model_client.ModelError("AUTH"))["attempts"] == 1
    assert ask(model_client.ModelError("PROVIDER_ERROR"), OSError(), "x")["content"] == "x"
    with pytest.raises(model_client.ModelError) as e:
        model_client.Settings.from_env({})
    assert e.value.code == "MISSING_ENV"
    try:
        try:
            raise model_client.ModelError("NETWORK")
        except model_client.ModelError as inner:
            raise ValueError from inner
    except ValueError as outer:
        assert model_client.error_code(outer) == "NETWORK"


def test_complete(spark):
    rows = spark.createDataFrame([(1, "p", None, None), (2, "p", "aW1n", "image/png")], "id long, prompt string, image string, mime string")
    got = {r.id: (r.model, r.content) for r in model_client.complete(rows, lambda: lambda m, msgs, t: (m, {}), "text", "vision").collect()}
    assert got == {1: ("text", "text"), 2: ("vision", "vision")}


# --- pages, declarations, scaffold, catalogue


def test_carousel(spark):
    html = "".join(f'<img src="https://h.test/g/a-{n}-x.jpg">' for n in ("012", "002", "007")) + '<img data-src="https://h.test/g/plain.jpg"><img src="https://h.test/g/a-002-x.jpg"><img src="https://h.test/ui/logo.png">'
    got = one(spark, html, lambda c: observe.slides(c, "/g/"))
    assert [u.rsplit("/")[-1] for u in got] == ["plain.jpg", "a-002-x.jpg", "a-007-x.jpg", "a-012-x.jpg"]
    assert one(spark, html, observe.label_image) is None
    assert one(spark, '<img src="https://h/x.jpg"><img src="https://h/nutrition-facts.jpg">', observe.label_image) == "https://h/nutrition-facts.jpg"


def test_declarations():
    d = platforms.Download("https://shop.test/x/")
    s = platforms.define_shopline_source("a", "shop.test", "p")
    assert s.selector is not None and s.catalog_discovery.url == "https://shop.test/sitemap.xml" and s.catalog_discovery.product_url_pattern == "p"
    s = platforms.define_shopline_source("a", "shop.test", "p", selector=None, catalog_discovery=None)
    assert s.selector is None and s.catalog_discovery is None
    assert platforms.define_bvshop_source("b", "b.test", "p", "42", download=d).catalog_discovery.url == "https://shop.test/x/sitemap.xml"
    assert platforms.define_cyberbiz_source("c", "c.test", "p", selector=None).commerce_platform.kind == "cyberbiz"
    with pytest.raises(ValueError, match="download"):
        platforms.define_shopline_source("a", "shop.test", "p", stage=print)


def test_scaffold(tmp_path):
    base = {"name": "shop", "raw_host": "a.test", "site_url": "https://a.test", "platform": "shopline"}
    for bad, problem in (({"name": "Example"}, "name"), ({"name": "9lives"}, "name"), ({"name": "with space"}, "name"), ({"name": ""}, "name"), ({"raw_host": "https://a.test"}, "rawHost"), ({"raw_host": "a.test/x"}, "rawHost"), ({"site_url": "a"}, "siteUrl"), ({"product_path_segment": "/"}, "productPathSegment"), ({"platform": "bvshop"}, "storeId"), ({"platform": "custom"}, "imageCdnHost"), ({"image_cdn_host": "h/x"}, "imageCdnHostShape")):
        with pytest.raises(scaffold.SpecError) as e:
            scaffold.check(scaffold.Spec(**(base | bad)))
        assert e.value.problem == problem
    for more in ({}, {"platform": "bvshop", "store_id": "42"}, {"platform": "custom", "image_cdn_host": "cdn.test"}, {"platform": "custom", "image_cdn_host": "cdn.test", "catalog_discovery": False}):
        if more.get("platform") != "custom":
            more = more | {"catalog_discovery": True}
        space = {}
        exec(scaffold.render(scaffold.Spec(**(base | more))), space)
        assert space["source"].name == "shop"
    out = tmp_path / "d" / "s.py"
    argv = ["--name", "shop", "--host", "a.test", "--platform", "shopline", "--out", str(out)]
    assert scaffold.run(argv)[1] == 0 and out.exists()
    assert scaffold.run(argv)[1] == 1 and scaffold.run([*argv, "--force"])[1] == 0
    assert scaffold.run(["--platform", "other"])[1] == 1


def test_inspect(spark):
    html = '<img src="https://cdn.x.test/a.jpg">'
    text = scaffold.inspect_html(spark, "https://shop.example.test/products/thing", html)
    assert "platform: custom" in text and "try custom_commerce_platform: " in text and "--cdn cdn.x.test" in text
    obs = json.loads(scaffold.inspect_html(spark, "https://shop.example.test/products/thing", html, as_json=True))
    assert scaffold.spec_of(obs, "n").image_cdn_host == "cdn.x.test"
    assert scaffold.spec_of(obs | {"image_hosts": []}, "n") is None


def test_catalogue():
    rows = catalogue.entries()
    assert len(rows) == len({(s, a, t) for s, a, t in rows}) and {"shopline", "walk_sitemaps", "project"} <= {r[0] for r in rows}
    text, code = catalogue.run(["--search", "ROBOTS"])
    assert code == 0 and catalogue.run(["--axis", "nope"])[1] == 1
    assert catalogue.run(["--search", "zzzz"]) == ("Nothing here covers that yet.", 0)
    assert len(json.loads(catalogue.run(["--json", "--axis", "ocr"])[0])) == len([r for r in rows if r[1] == "ocr"])


def test_snapshots(spark, tmp_path):
    from storeloom.streaming import snapshots

    path, seen = str(tmp_path / "raw"), []
    row = lambda *r: spark.createDataFrame([r], snapshots.SCHEMA)
    handle = lambda rows, _: seen.extend(sorted(r.product_id for r in rows.collect()))
    snapshots.write_snapshot(row("1", "a", "h.test", "2026-Q2"), path)
    snapshots.process_new(spark, path, handle, str(tmp_path / "ck"))
    snapshots.write_snapshot(row("2", "b", "h.test", "2026-Q3"), path)
    snapshots.process_new(spark, path, handle, str(tmp_path / "ck"))
    assert seen == ["1", "2"]
    assert [r.html for r in snapshots.read_snapshot(spark, path, "h.test", "2026-Q2").collect()] == ["a"]


def test_phases(spark, tmp_path):
    from storeloom.plans.phases import run_phases

    ran = []

    def phase(name):
        def step(rows):
            ran.append(name)
            return rows.withColumn("n", F.col("n") + 1)

        return step

    start = spark.createDataFrame([(0,)], "n long")
    steps = {name: phase(name) for name in ("score", "download", "stage")}
    assert run_phases(spark, start, steps, str(tmp_path)).first().n == 3
    assert ran == ["download", "stage", "score"]
    assert run_phases(spark, start, steps, str(tmp_path)).first().n == 3 and len(ran) == 3
    with pytest.raises(ValueError, match="nope"):
        run_phases(spark, start, {"nope": phase("nope")}, str(tmp_path))


def test_inspect_command(spark, tmp_path):
    from storeloom.operators import inspect_page

    page = tmp_path / "p.html"
    page.write_text('<img src="https://shoplineimg.com/a/b.jpg">')
    url = "https://shop.example.test/products/thing"
    assert "shopline" in inspect_page.run([url, "--html", str(page)], spark=spark)[0]
    text, code = inspect_page.run([url, "--scaffold", "shop"], fetch=lambda u: page.read_text(), spark=spark)
    assert code == 0 and "define_shopline_source" in text
    assert inspect_page.run([url], spark=spark)[1] == 1
    assert inspect_page.run([url, "--scaffold", "x"], fetch=lambda u: "", spark=spark)[1] == 1


def test_violations():
    from storeloom.sources import model_client as m

    schema = {"type": "object", "required": ["name", "tags"], "properties": {"name": {"type": "string", "minLength": 2}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}, "n": {"type": ["integer", "null"], "minimum": 0, "maximum": 9}}}
    assert m.violations({"name": "ab", "tags": ["a", "b"], "n": None, "more": 1}, schema) == []
    bad = m.violations({"name": "a", "tags": ["a", "c", 3], "n": 12}, schema)
    assert bad == ["$.name: shorter than 2", "$.tags[1]: not one of ['a', 'b']", "$.tags[2]: not string", "$.n: beyond maximum 9"]
    assert m.violations([], schema) == ["$: not object"] and m.violations({}, schema) == ["$.name: missing", "$.tags: missing"]
    assert m.violations(True, {"type": "integer"}) and not m.violations(True, {"type": "boolean"})
    assert m.checker(schema)({"name": "ab", "tags": []}) and not m.checker(schema)({}) and m.checker(None) is None


def test_source_hooks(spark):
    from storeloom.operators import stages

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "page_id long, url string")
    plain = platforms.define_shopline_source("a", "shop.test", "p")
    assert stages.run_source(plain, rows).count() == 3
    whole = platforms.define_shopline_source("a", "shop.test", "p", download=platforms.Download("https://shop.test"), stage=lambda r: r.withColumn("n", F.lit(1)), reconcile=lambda r: r.distinct(), structured_facts=lambda r: r.groupBy("page_id").agg(F.count("*").alias("seen")))
    assert sorted(map(tuple, stages.run_source(whole, rows).select("page_id", "n", "seen").collect())) == [(1, 1, 2), (2, 1, 1)]
    clash = platforms.define_shopline_source("a", "shop.test", "p", structured_facts=lambda r: r)
    with pytest.raises(ValueError, match="url"):
        stages.run_source(clash, rows)


def test_catalogue_tables(spark):
    known = catalogue.table(spark)
    assert catalogue.parity(known, known).count() == 0
    less = known.where("symbol <> 'project'")
    assert [tuple(r) for r in catalogue.parity(less, known).collect()] == [("project", "catalogue")]
    assert {r.symbol for r in catalogue.matching(known, "http", "disallowed").collect()} == {"disallowed"}
