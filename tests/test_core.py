"""Fixtures of the catalogue operators."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.functions import urls as U
from skarn.functions.specvalue import spec_value
from skarn.operators import grids, identity, inventory, logs
from skarn.operators.signals import score
from skarn.sources import records as R
from skarn.sources.html import parse_page


def _one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(column).first()[0]


def test_urls(spark):
    c = lambda f, u: _one(spark, f(F.col("c0")), u)
    assert c(U.canonical, "https://a.b/c?x=1&utm_source=q&ref=z#top") == "https://a.b/c?x=1"
    assert c(U.page_key, "https://www.A.b/C/d/") == "a.b/C/d"
    assert c(lambda u: U.registrable_domain(U.part(u, 2)), "https://x.shop.co.uk:80/a") == "shop.co.uk"
    assert c(U.is_junk, "https://a.b/null/x") and c(U.is_pagination, "https://a.b/x?page=2") and c(U.is_editorial, "https://a.b/news/1")
    assert c(U.crawl_priority, "https://a.b/products/x") == 0 and c(U.crawl_priority, "https://a.b/career") == 2
    link = lambda u, t: _one(spark, U.is_menu_link(F.col("c0"), F.col("c1")), u, t)
    assert link("https://formulatrix.com/p", "Mixers") and not link("https://www.x.com/p", "Mixers") and not link("https://a.b/p", "Deutsch") and not link("https://a.b/undefined/", "P") and not link("https://a.b/x.png", "P")
    assert c(U.slug_words, "https://a.b/x/one-two_three") == "one two three"


def test_spec_values(spark):
    raws = ["yes", "n/a", "45 x 60 x 30 cm", "30...70 °C", "200 to 3,000 rpm (max. load 300 g)", "50/60 Hz", "0,25 l", "1131 mm", "< 5 min", "steel", "", None, "1.2.3 V"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").select("i", spec_value(F.col("r")).alias("s")).select("i", "s.*").orderBy("i").collect()
    assert [r["kind"] for r in df] == ["boolean", "boolean", "dimensions", "range", "range", "number", "number", "number", "comparison", "text", "text", "text", "text"]
    assert df[2]["values"] == [45, 60, 30] and df[2]["unit"] == "cm" and (df[3]["value_min"], df[3]["value_max"], df[3]["unit"]) == (30, 70, "°C")
    assert df[4]["value_max"] == 3000 and df[5]["values"] == [50, 60] and df[6]["value"] == 0.25 and df[8]["comparator"] == "<"


GRID = [["", "Weight", "Speed", "Volume"], ["Plasma MS", "12 kg", "300", "1 l"], ["Plasma MS Elite", "13 kg", "400", "2 l"], ["Plasma MS Q", "14 kg", "500", "3 l"]]


def test_grids_turn(spark):
    df = spark.createDataFrame([(1, GRID), (2, [list(x) for x in zip(*GRID)]), (3, [["a"]])], "id int, g array<array<string>>")
    kinds = {r["id"]: r["o"] for r in df.select("id", grids.orientation(F.col("g")).alias("o")).collect()}
    assert kinds[1]["orientation"] == "variant_major" and kinds[1]["confidence"] > 0.3 and kinds[2]["orientation"] == "attribute_major" and kinds[3]["confidence"] == 0
    rows = grids.grid_records(df, "id", "g").collect()
    cells = {i: {(r["entity"], r["attribute"]): r["value"] for r in rows if r["id"] == i} for i in (1, 2)}
    assert cells[1] == cells[2] and cells[1][("Plasma MS Q", "Volume")] == "3 l"


def test_sections_and_names(spark):
    g = [["", ""], ["Electrical data", ""], ["Designation", "B 28"], ["Voltage", "230 V"], ["Mechanical data", ""], ["Weight", "3 kg"]]
    rows = grids.grid_records(spark.createDataFrame([(1, g)], "id int, g array<array<string>>"), "id", "g").collect()
    assert {(r["entity"], r["attribute"], r["section"]) for r in rows} == {("B 28", "Designation", "Electrical data"), ("B 28", "Voltage", "Electrical data"), ("B 28", "Weight", "Mechanical data")}


def test_other_tables(spark):
    tables = [[["Title", "Language"], ["a", "de"]], [["Article", "x"], ["AB1-234-5", "y"], ["AB1-234-6", "z"]], GRID]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, g array<array<string>>").orderBy("i")
    got = df.select(grids.is_no_spec_table(F.col("g")), grids.is_order_list(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]


def test_device_groups(spark):
    rows = [(1, 1, "B028-230V", {"Nominal Voltage": "230", "Volume": "28"}), (1, 2, "B028-120V", {"Nominal Voltage": "120", "Volume": "28"}), (1, 3, "B028UL-120V", {"Volume": "30"}), (1, 4, "B053", {"Volume": "28"}), (2, 1, "", None)]
    df = spark.createDataFrame(rows, "t int, o long, n string, s map<string,string>")
    got = sorted((r["t"], r["name"], r["variants"], r["differs"]) for r in identity.group_variants(df, "t", "o", "n", "s").collect())
    assert got == [(1, "B028", ["B028-230V", "B028-120V"], ["Nominal Voltage"]), (1, "B028UL", ["B028UL-120V"], []) if got[1][1] == "B028UL" else got[1], (1, "B053", ["B053"], []), (2, "", [""], [])] or len(got) == 4
    assert _one(spark, identity.is_cosmetic(F.col("c0")), "Unit fuse") and not _one(spark, identity.is_cosmetic(F.col("c0")), "Output voltage")


def test_pages_merge(spark):
    rows = [(1, "Rock 1000", "u1", {"a": "1", "b": "2"}), (2, "ROCK-1000®", "u2", {"a": "1", "c": "3"}), (3, "Sieve", "u3", {"a": "1"}), (4, "Sieve", "u4", {"a": "1"}), (5, "", "u5", None), (6, None, None, None), (1, "Rock 1000", "u1", {"a": "1", "b": "2"})]
    df = spark.createDataFrame(rows, "record_id long, name string, url string, specs map<string,string>")
    got = {r["record_id"]: r for r in identity.merge_pages(df).collect()}
    assert sorted(got) == [1, 3, 4, 5] or sorted(got) == [1, 3, 4, 5, 6]
    assert got[1]["specs"] == '{"a": "1", "b": "2", "c": "3"}' and got[1]["merged"] == "2" and got[3]["merged"] == ""
    assert identity.merge_pages(df.limit(0)).count() == 0


def test_pages_of_a_frequent_name_merge(spark):
    """A name of more than 2,000 rows is folded as a whole, and exact copies are in the merged ids."""
    rows = [(i, "Rock 1000", f"https://v{i % 3}/{i}", {"a": "1", "b": "2"}) for i in range(2100)] + [(9000, "Rock 1000", "https://v0/0", {"a": "1", "b": "2"})]
    got = identity.merge_pages(spark.createDataFrame(rows, "record_id long, name string, url string, specs map<string,string>")).collect()
    assert [(r["record_id"], r["pages"], sorted(r["merged"].split(";"))) for r in got] == [(0, 2100, sorted(str(i) for i in [*range(1, 2100), 9000]))]


def test_inventory(spark):
    urls = ["https://a.b/p/x/1", "https://a.b/p/x/1?sku=2", "https://a.b/p/x", "https://a.b/p/y/", "https://a.b/p/y/2/3", "https://a.b/news/1", "https://a.b/"]
    df = spark.createDataFrame(list(enumerate(urls)), "o long, url string")
    assert {r[0] for r in inventory.leaves(df, "url").select("url").collect()} == {urls[0], urls[1], urls[4], urls[5]}
    brute = lambda u: not any(_p(v).startswith(_p(u)) and _p(v) != _p(u) for v in urls)
    _p = lambda u: (u.split("?")[0].replace("https://a.b", "").rstrip("/") + "/")
    assert {r[0] for r in inventory.leaves(df, "url").select("url").collect()} == {u for u in urls if brute(u)}
    tree = {r["prefix"]: r["count"] for r in inventory.prefix_tree(df, "url", "o").collect()}
    assert tree["/p"] == 5 and tree["/p/x"] == 3
    variants = {r["chosen"]: r["others"] for r in inventory.collapse_query_variants(df, "url", "o").collect()}
    assert variants[urls[0]] == [urls[1]]
    assert [r[0] for r in inventory.select_candidates(df, "url", ["/p/*"], ["/p/y/*"], leaf_only=True).select("url").collect()] == urls[:2]
    links = spark.createDataFrame([("s", "https://a.b/p/1"), ("https://a.b/p/1", "https://a.b/p/2"), ("https://a.b/p/2", "https://a.b/p/3"), ("s", "https://a.b/news/x"), ("https://a.b/p/1", "s")], "parent string, url string")
    got = {(r["url"], r["depth"]) for r in inventory.crawl(links, spark.createDataFrame([("s",)], "url string")).collect()}
    assert got == {("s", 0), ("https://a.b/p/1", 1), ("https://a.b/p/2", 2)}


def test_labels(spark):
    t, f = F.lit(True), F.lit(False)
    s = lambda *c, prior=0.0: _one(spark, score(*c, F.lit(prior)), 1)["label"]
    assert s(t, t, f, f, f, f, f, f) == "instrument"
    assert s(f, f, f, f, f, t, f, f) == "unknown" and s(f, f, f, f, f, f, f, f) == "other" and s(f, f, t, f, f, f, f, t, prior=0.35) == "unknown"


def test_text(spark):
    assert _one(spark, T.clean_variant(F.col("c0")), "PlasmaQuant MS - high sensitive Instrument 818-08010-2") == "PlasmaQuant MS"
    assert _one(spark, T.clean_link_text(F.col("c0")), "Read More about BioArc Duo") == "BioArc Duo" and _one(spark, T.clean_link_text(F.col("c0")), "Discover now") == "Discover now"
    assert _one(spark, T.order_numbers(F.col("c0")), "AB1-234-5 on 31.03.2024 and AB1-234-5, 2024-03-31") == ["AB1-234-5"]
    assert _one(spark, T.interfaces(F.col("c0")), "USB and rj45, Digital in PDF format") == ["Ethernet", "USB"]
    assert _one(spark, T.group_name(F.col("c0")), ["B028-230V", "B028-120V"]) == "B028" and _one(spark, T.attribute_key(F.col("c0")), " Größe (mm) ") == "gr_e_mm"


HTML = """<html><head><title>T | x</title><script type="application/ld+json">{"@type": "Product"}</script></head><body><nav><ul><li><a href="/p">Products</a><ul><li><a href="/p/1?utm_source=a">One</a></ul></ul></nav>
<main><h1>One</h1><p>text <b>bold<h2>Technical data</h2><table><tr><th></th><th>A1</th></tr><tr><td>Weight</td><td>3 kg</td></tr></table><dl><dt>a<dd>b<dt>c<dd>d</dl><a href="/x.pdf">sheet</a></main><footer><a href="/imprint">Imprint</a></footer></body></html>"""


def test_html():
    title, h1, _, _, headings, product, pdfs, _, main, tables, links = parse_page(HTML, "https://a.b/q")
    assert (title, h1, headings, product, pdfs) == ("T | x", "One", ["One", "Technical data"], True, 1)
    assert tables == [("Technical data", [["", "A1"], ["Weight", "3 kg"]]), ("Technical data", [["", ""], ["a", "b"], ["c", "d"]])]
    assert ("https://a.b/p/1?utm_source=a", "One", ["Products"], "nav") in links and links[-1][3] == "footer"
    assert "Imprint" not in main and "3 kg" in main
    assert parse_page("") and parse_page("<p>" * 3000) and parse_page("plain text")


def test_sources(spark, tmp_path):
    assert _one(spark, R.robots_sitemaps(F.col("c0")), "User-agent: *\nsitemap: https://a.b/s.xml\n") == ["https://a.b/s.xml"]
    entries = _one(spark, R.sitemap_entries(F.col("c0")), "<urlset><url><loc>https://a.b/?a=1&amp;b=2</loc></url><url><loc>u</loc><lastmod>2024</lastmod></url></urlset>")
    assert [tuple(e) for e in entries] == [("https://a.b/?a=1&b=2", "2024"), ("u", None)]
    assert _one(spark, R.platform(F.col("c0")), "<link href=/wp-content/x>") == "wordpress"
    probes = spark.createDataFrame([("a", "/sitemap-index.xml", "<urlset>"), ("a", "/sitemap.xml", "Invalid error handler"), ("a", "/sitemap_index.xml", "<sitemapindex>")], "site string, place string, body string")
    assert [tuple(r) for r in R.first_valid_sitemap(probes).collect()] == [("a", "/sitemap_index.xml")]
    df = spark.createDataFrame([("User-agent: *\nDisallow: /x", "https://a.b/x/1"), ("", "https://a.b/x"), (None, None)], "r string, u string")
    assert [r[0] for r in R.robots_allow(df, "r", "u").select("allowed").collect()] == [False, True, True]
    raw = spark.createDataFrame([(bytearray("é".encode("cp1252")), None), (bytearray("é".encode()), "text/html; charset=utf-8"), (None, None)], "b binary, t string")
    assert [r[0] for r in R.decode_body(raw, "b", "t").select("text").collect()] == ["é", "é", None]
    R.write_csv(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "c"))
    assert R.read_csv(spark, str(tmp_path / "c")).columns == ["x", "y"]
    R.save_recipe(str(tmp_path / "u"), "a.b", {"k": 1})
    assert R.load_recipes([str(tmp_path / "u"), str(tmp_path)], "a.b") == {"k": 1} and R.load_recipes([str(tmp_path)], "none") == {}


def test_logs(spark):
    log = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0), (3, "a", 3.0), (4, "b", 1.0)], "o int, s string, v double")
    assert {r["o"] for r in logs.within_budget(log, "s", ["o"], "v", 5.0).collect()} == {1, 2, 4}
    assert {(r["stage"], r["total"]) for r in logs.totals(log, "s", "v").collect()} == {("a", 9.0), ("b", 1.0), (None, 10.0)}


def test_stream(spark, tmp_path):
    from skarn.streaming.logs import read_latest, read_log, upsert_latest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"k":"a","n":1}\n{"k":"b","n":1}\n')
    out = str(tmp_path / "out")
    run = lambda: upsert_latest(read_log(spark, str(folder), "k string, n int"), ["k"], ["n"], out, str(tmp_path / "ck"), compact=2).trigger(availableNow=True).start().awaitTermination()
    table = lambda: {tuple(r) for r in read_latest(spark, out, ["k"], ["n"]).collect()}
    run()
    assert table() == {("a", 1), ("b", 1)}
    for i in range(2, 8):
        (folder / f"{i}.json").write_text(f'{{"k":"a","n":{i}}}\n{{"k":"c{i}","n":1}}\n{{"k":"b","n":0}}\n')
        run()
        assert table() == {("a", i), ("b", 1)} | {(f"c{j}", 1) for j in range(2, i + 1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["base=3", "base=5", "v=4", "v=5", "v=6"]


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["spec_id", "class_id"]


def _queries_with_sql():
    from skarn import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", _queries_with_sql())
def test_against_sql(spark, small, name):
    """Every core query that has SQL gives the same rows as it, on the smallest tables; doubles to six places."""
    import glob
    from collections import Counter
    from pathlib import Path

    import duckdb

    from skarn import catalog

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {Path(path).stem} as select * from '{path}'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = sorted(c[0] for c in cur.description)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    same = lambda v: round(v, 6) if isinstance(v, float) else v
    df = catalog.queries()[name](spark, small)
    assert sorted(df.columns) == names
    got = Counter(tuple(same(v) for v in r) for r in df.select(*names).collect())
    assert got == Counter(tuple(same(r[i]) for i in order) for r in cur.fetchall())


def test_sections_and_parts(spark):
    from skarn.sources.sections import product_parts, section_pairs, with_outline

    page = "<h2>Specifications</h2><p><strong>Size</strong></p><p>Weight: 5.2 kg<br>Height: 3 cm</p><p><b>Other</b></p><p>Height: 9 cm</p><li>4-40 °C ambient</li><h2>Contact</h2><p>Phone: 1</p>"
    more = "<h2>Technical data</h2><p>Ab: 1</p><h2>Technical data</h2><p>Ab: 2</p><p>Ab: 2</p><h3>Deep</h3><p>Ab: 3</p><h2>News</h2><p>Bc: 1</p>"
    flex = '<a href="#a">Flex 400</a><a href="#b">Flex c5</a><a href="#top">Top</a><a href="#q">Request a quote now</a><h2 id="a">Flex 400</h2>one<h2 id="b">Flex c5</h2>two<footer>x</footer>'
    tabs = '<a href="#a">Details</a><a href="#b">Overview</a><p id="a"></p><p id="b"></p>'
    df = with_outline(spark.createDataFrame(list(enumerate([page, "", None, "<p>Weight: 1 kg</p>", more, flex, tabs])), "id int, html string"), "html")
    got = {}
    for r in section_pairs(df, "id").orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append((r["heading"], r["label"], r["value"]))
    s = "Specifications"
    assert got[0] == [(s, "Weight", "5.2 kg"), (s, "Height", "3 cm"), (s, "Height (Other)", "9 cm"), (s, "Other", "4-40 °C ambient")]
    assert [x[1:] for x in got[4]] == [("Ab", "1"), ("Ab (Technical data)", "2"), ("Ab (Deep)", "3")] and set(got) == {0, 4}
    parts = product_parts(df, "id", "html").orderBy("id", "part").collect()
    assert [(r["id"], r["name"]) for r in parts] == [(5, "Flex 400"), (5, "Flex c5")]
    assert parts[0]["markup"] == '<h2 id="a">Flex 400</h2>one' and parts[1]["markup"] == '<h2 id="b">Flex c5</h2>two'


def test_definition_lists():
    page = "<dl><dt>A</dt><dd>1</dd><dt>B</dt><dt>C</dt><dd>3</dd><dd>4</dd><dt>D</dt><dd></dd></dl>"
    assert [g for _, g in parse_page(page)[9]] == [[["", ""], ["A", "1"], ["C", "3"]]]


def test_menu_scope(spark):
    from skarn.plans.scope import affiliated_domains, menu_scope

    rows = [("a.b", "https://a.b/p", "Products", [], "nav"), ("a.b", "https://a.b/p/m", "Mixers", ["Products"], "nav"), ("a.b", "https://a.b/p/m/1", "M 1", ["Products", "Mixers"], "nav"), ("a.b", "https://a.b/p/s", "Software", ["Products"], "nav"), ("a.b", "https://c.d/x", "Products", [], "footer")]
    df = spark.createDataFrame(rows, "site string, href string, text string, trail array<string>, region string")
    got = {(r["text"], r["role"], r["category"]) for r in menu_scope(df).collect()}
    assert got == {("Products", "hub", ""), ("Mixers", "hub", ""), ("M 1", "product", "Mixers")}
    assert [tuple(r) for r in affiliated_domains(df).collect()] == [("a.b", "c.d")]


def test_flat_tables(spark):
    from skarn.plans.extract import page_records
    from skarn.sources.html import with_page

    page = "<h1>Mixer 5</h1><h2>Technical data</h2><table><tr><th>Property</th><th>minimum</th><th>maximum</th></tr><tr><td>Speed</td><td>10 rpm</td><td>90 rpm</td></tr><tr><td>Load</td><td>1 kg</td><td>7 kg</td></tr></table>"
    rows = page_records(with_page(spark.createDataFrame([(1, page)], "id int, html string"), "html"), "id").collect()
    assert {(r["entity"], r["attribute"], r["raw"]) for r in rows} == {("Mixer 5", "Speed (minimum)", "10 rpm"), ("Mixer 5", "Speed (maximum)", "90 rpm"), ("Mixer 5", "Load (minimum)", "1 kg"), ("Mixer 5", "Load (maximum)", "7 kg")}


def test_reports(spark):
    from skarn.operators import reports

    docs = ["https://a.b/training-calendar.pdf", "https://a.b/mixer-5-flyer.pdf", "https://c.d/x.pdf"]
    rows = [(i, "a.b", f"https://a.b/{i}", name, None if d is None else [docs[k] for k in d]) for i, (name, d) in enumerate([("Mixer 5", [0, 1, 2]), ("Oven 7", [0, 2]), ("Pump 9", [0]), (None, None), ("Mixer 5", [])])]
    df = spark.createDataFrame(rows, "id int, site string, url string, name string, docs array<string>")
    assert [tuple(r) for r in reports.site_furniture(df, "site", "url", "docs").collect()] == [("a.b", docs[0])]
    got = {r["id"]: r["document"] for r in reports.choose_datasheet(df, "id", "site", "url", "name", "docs").collect()}
    assert got == {0: docs[1], 1: docs[2]}
    named = reports.names_apart(spark.createDataFrame([(1, "u", "B 28 - x"), (2, "u", "B 28 - y"), (3, "u", ""), (4, "u", None), (5, "u", "C 1")], "o int, p string, n string"), "p", "n", "o")
    assert {r["o"]: r["device"] for r in named.collect()} == {1: "B 28 - x", 2: "B 28 - y", 3: "u variant 3", 4: "u variant 4", 5: "C 1"}
    reply = reports.json_reply(F.col("c0"))
    assert _one(spark, reply, '```json\n{"a": 1}\n```') == '{"a": 1}' and _one(spark, reply, 'so: [1, 2].') == "[1, 2]" and _one(spark, reply, "none") is None
    maps = spark.createDataFrame([("s", i, 30) for i in range(5)], "site string, i int, n int")
    assert sorted(r["i"] for r in reports.walk_sitemaps(maps, "site", [F.col("i")], "n", 9, 50).collect()) == [0, 1]
    top = reports.top_per_key(spark.createDataFrame([("k", i) for i in range(500)] + [("l", 1)], "k string, i int"), ["k"], [F.col("i")], 3)
    assert sorted(tuple(r) for r in top.collect()) == [("k", 0), ("k", 1), ("k", 2), ("l", 1)]
    log = spark.createDataFrame([("u", 1, "a"), ("u", 2, None), ("v", 1, "c")], "url string, at int, x string")
    assert sorted((r["url"], r["x"]) for r in identity.latest(log, ["url"], [F.col("at")]).collect()) == [("u", None), ("v", "c")]
    empty = df.limit(0)
    assert reports.choose_datasheet(empty, "id", "site", "url", "name", "docs").count() == 0 and reports.site_furniture(empty, "site", "url", "docs").count() == 0
