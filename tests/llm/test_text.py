"""Tokens, garbled text, lines of pages, detectors: functions and operators on small fixtures."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.llm.boilerplate import AROUND, LEAN, NAMED, RECURS, TAKEN, THIN, is_around, page_features, roles_of
from skarn.llm.garbled import mend, restore
from skarn.llm.residue import MESSAGE, detector, is_message
from skarn.llm.tokens import Automaton, VOCABULARIES, compile_vocabulary, decode_column, encode_column

TEXTS = [
    "Das Gehäuse hält „Störung 5“ – 20 °C für 3 µL", "L’écran règle l’étalonnage à 5 °C", "MANUTENÇÃO: a CÂMARA não está em operação", "Urządzenie utrzymuje temperaturę z dokładnością", "Прибор поддерживает температуру с точностью ±2,6 °C", "内部はステンレス製で清掃が簡単です。温度を保ちます。",
]
CORRECT = TEXTS + [
    "ATENÇÃO «À» Ø 7 mm ∞ √9 ≈ 3, ΔT = 4 K, 3 m³/h, 5 µm, 6 μm, 309 min⁻¹", "├── config\n│   └── a.ini\n┬┐", "n° 5 – Nº 3 … “x” „y“ ‚z‘", "ﬂow reﬂection naïve façade Łódź Åland Søren Größe ß“", "С… Рё «В»: 20 В±10 %", "AT&amp;T R&D &lt;b&gt;", "", " ", "👩‍🔬 é ​", "mot—à Paris, –époque",
]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_stays(text):
    assert restore(text) == (False, text, [])


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
def test_utf8_read_wrongly(codec):
    for text in TEXTS[:3]:
        wrong = "".join(bytes([b]).decode(codec, "replace") if codec != "cp1252" or bytes([b]).decode(codec, "ignore") else chr(b) for b in text.encode())
        if "�" in wrong:
            continue
        found, back, how = restore("Vor. " + wrong + " Nach.")
        assert found and back == "Vor. " + text + " Nach.", (codec, wrong, back)


def test_stacked_and_escaped():
    once = "Gehäuse".encode().decode("cp1252")
    assert restore(once.encode().decode("cp1252"))[1] == "Gehäuse"
    assert restore("Geh&Atilde;&curren;use")[1] == "Gehäuse"


def test_single_byte_pairs():
    assert restore("The résumé of".encode("cp1252").decode("cp1251"))[:2] == (True, "The résumé of")
    assert restore("Gehäuse prüft".encode("cp1252").decode("mac_roman"))[:2] == (True, "Gehäuse prüft")
    assert restore("z dokładnością około".encode("cp1250").decode("cp1252"))[0]
    assert restore("Прибор поддерживает температуру".encode("cp1251").decode("cp1252"))[:2] == (True, "Прибор поддерживает температуру")
    assert restore("Перед первым включением".encode("koi8_r").decode("cp1251"))[0]
    assert restore(TEXTS[5].encode("cp932").decode("latin_1"))[:2] == (True, TEXTS[5])
    assert restore("Geh�use") == (True, "Geh�use", ["lost"])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_restores(text):
    restore(text)


def test_mend_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "GehÃ¤use " * 20000, "c"), (4, "ok", "d"), (4, "ok", "d")]
    got = mend(spark.createDataFrame(rows, "doc_id long, text string, garbled string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["garbled"]) for r in got] == [(1, False), (2, False), (3, True), (4, False), (4, False)]
    assert got[2]["restored"] == "Gehäuse " * 20000 and got[0]["restored"] is None
    assert mend(spark.createDataFrame([], "doc_id long, text string")).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{VOCABULARIES}/byte_bpe_50k.json"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def automaton():
    return compile_vocabulary()


@needs_vocabulary
def test_tokens_equal_the_library(automaton):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(5)
    texts = [*CORRECT, *("".join(rng.choice("aab etnzZ=-\n'09äé語<|endoftext|>   ") for _ in range(rng.randint(1, 60))) for _ in range(3000)), *("a" * n for n in range(99)), *("=-" * n for n in range(60)), "<|endoftext|>", "x" * 20000]
    for text in texts:
        assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert automaton.decode(automaton.encode(text)) == text


def _merged(word: bytes, merges) -> list[bytes]:
    """Merges in their order, each from left to right."""
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


def test_compiled_table_is_that_of_merging_one_by_one():
    rng = random.Random(5)
    for _ in range(60):
        ids = {bytes([b]): i for i, b in enumerate(b"abc")}
        merges = []
        for _ in range(40):
            u, v = rng.choice(list(ids)), rng.choice(list(ids))
            if u + v not in ids and _merged(u + v, merges) == [u, v]:  # training merges only pairs that occur
                merges.append((u, v))
                ids[u + v] = len(ids)
        automaton = Automaton(ids, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            assert automaton.encode_bytes(word) == [ids[p] for p in _merged(word, merges)], (merges, word)
    with pytest.raises(ValueError):
        Automaton({b"a": 0, b"b": 1, b"ab": 2}, [(b"a", b"b"), (b"a", b"b")])


@needs_vocabulary
def test_arcs_are_exactly_the_pairs_that_stay(automaton):
    """An arc from a to b is there exactly if encoding the bytes of both gives both."""
    rng = random.Random(7)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        if automaton.labels[a] and automaton.labels[b]:
            assert automaton.follows(a, b) == (automaton.encode_bytes(automaton.labels[a] + automaton.labels[b]) == [a, b])


@needs_vocabulary
def test_token_columns(spark, automaton):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Gehäuse 5", 5)], "doc_id long, text string, ids int")
    got = encode_column(df, "text", "ids", automaton).orderBy("doc_id")
    assert [r["ids"] for r in got.select("ids").collect()][:2] == [[], []]
    back = decode_column(got, "ids", "back", automaton).orderBy("doc_id").select("back").collect()
    assert [r[0] for r in back] == ["", "", "Gehäuse 5"]


@pytest.mark.parametrize("text,kind", [
    ("{{ item_title }}", "placeholder"), ("<%= item_price %>", "placeholder"), ("##LONG_TEXT##", "placeholder"), ("[object Object]", "placeholder"), ("Lorem ipsum elit dolor, amet sit porta consectetur.", "filler"), ("undefined undefined NaN", "filler"), ("Titel", "filler"),
    ("Error 404", "message"), ("Access denied. You do not have permission to view this resource.", "message"), ("Please enable JavaScript to continue.", "message"), ("Zugriff verweigert.", "message"), ("ref 6rwkk", "message"),
    ("Error 503 on the display means that the pump service is not available; refill the coolant and restart.", ""), ("Access denied messages of the user management are logged with the operator name.", ""),
    ("The web interface of the instrument needs a browser with JavaScript; scripts for {{port}} settings are stored in the device.", ""), ("Touchscreen: yes", ""),
])
def test_detectors(text, kind):
    assert detector(text) == kind


LONG_MESSAGE = "Fatal error: uncaught exception 'PDOException' with message 'could not connect to database' in /srv/shop/lib/db.php:88 stack trace: " + " ".join(f"#{i} /srv/shop/lib/module_{i}.php({i}1): connect()" for i in range(9))


def test_long_blocks_are_detected():
    """Messages and phrases of surroundings count whatever the length of their block, and a sentence counts once."""
    assert len(LONG_MESSAGE) > 300 and detector(LONG_MESSAGE) == "message"
    cookies = "We use cookies to give you the best experience on our website. " + "They remember your language and the goods in your cart. " * 6
    assert _kept(f"<html><body>\n<p>{cookies}</p>\n<p>This sentence is on one page only, it is the content.</p>\n</body></html>") == [3]
    codes = page_features(f"<html><body>\n<p>{LONG_MESSAGE}</p>\n</body></html>", "https://v/x")[3]
    assert codes[0] & TAKEN


def _kept(source, facts=None, url=None):
    """Numbers of the main lines of a body, given what is known of hashes."""
    no, hashes, _, codes, tree, first, last, _, _ = page_features(source, url)
    return [n for n, main in zip(no, roles_of(no, hashes, codes, list(zip(tree, first, last)), facts or {})) if main]


def test_searchers_find_what_the_patterns_find():
    rng = random.Random(8)
    words = [w for p in (MESSAGE, AROUND) for w in p.pattern.replace("(?:", "|").replace("(", "|").replace(")", "|").replace("?", "").replace("\\b", "").replace("^", "").replace("$", "").split("|") if w] + ["#", "©", "\u0130", "x", "\n"]
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        text = rng.choice([text, text.upper(), text.title()])
        assert is_message(text) == bool(MESSAGE.search(text)) and is_around(text) == bool(AROUND.search(text)), text


PAGE = """<html><head><title>Korvand Gleam 4752 – counter | shop</title><style>x</style></head><body>
<nav><ul><li><a href="/a">Home</a></li>
<li><a href="/b">Cart (0)</a></li></ul></nav>
<main>
<div class="breadcrumb">Home &gt; Products &gt; Counters</div>
<h1>Korvand Gleam 4752 – counter</h1>
<p>The supplied software reaches the set temperature
of 264 °C with a repeatability of 1.4 %.</p>
<table><tr><td>Touchscreen</td><td>yes</td></tr></table>
<ul><li>Helix 4250-51</li></ul>
</main>
<aside><p>Related products</p>
<p>Korvand Cirrus 4606</p></aside>
<footer><p>© 2024 Shop. All rights reserved.</p></footer></body></html>"""


def test_main_lines():
    assert _kept(PAGE) == [6, 7, 8, 9, 10] and page_features(PAGE)[4]
    plain = "Home\nCart (0)\nHome > Products > Counters\nKorvand Gleam 4752\nReadings drift by less than 5.6 % per year on 91 units.\nTouchscreen: yes\nRelated products\nKorvand Cirrus 4606\n© 2024 Shop. All rights reserved."
    other = page_features(plain)[1][7]
    assert _kept(plain, {other: NAMED | THIN | LEAN}) == [4, 5, 6]  # the last name is that of another page
    assert page_features("") == ([], [], [], [], [], [], [], [], False) and page_features("<div>" * 500)[0] == []


def test_recurring_subtrees_are_deleted():
    body = "<html><body>\n<div>\n<div>This sentence is on all pages of the shop, see below.</div>\n<div>Gamma delta</div>\n</div>\n<p>This sentence is on one page only, it is the content.</p>\n</body></html>"
    tree = page_features(body)[4][0]
    assert _kept(body) == [3, 4, 6] and _kept(body, {tree: RECURS | LEAN}) == [6]


def _site(spark, tmp_path, bodies, log, records=()):
    """Tables of a site: bodies (html), log (url, index of the body, status)."""
    rows = [(i, f"b{i}", html) for i, html in enumerate(bodies)]
    spark.createDataFrame(rows, "body_id long, body_path string, html string").write.parquet(str(tmp_path / "page_bodies.parquet"))
    fetches = [(i, "v", url, f"b{b}", status, "live") for i, (url, b, status) in enumerate(log)]
    spark.createDataFrame(fetches, "fetch_id long, vendor string, url string, body_path string, status int, source string").write.parquet(str(tmp_path / "fetch_index.parquet"))
    spark.createDataFrame(list(records), "listing_id long, vendor string, description string").write.parquet(str(tmp_path / "device_records.parquet"))


def test_counts_per_host_decide_the_lines(spark, tmp_path, monkeypatch):
    """The method moves rows: what recurs on the host's pages is removed by its count alone, without markup or phrases."""
    from skarn.llm import boilerplate

    page = lambda i: f"<html><body>\n<p>Visit our show room, we are looking forward to meeting you.</p>\n<p>{'abcdefgh'[i]} item keeps the temperature in room {'abcdefgh'[i]} steady.</p>\n</body></html>"
    _site(spark, tmp_path, [page(i) for i in range(8)], [(f"https://v/item-{i}", i, 200) for i in range(8)])
    kept = lambda: sorted((r["row_id"], r["line_no"]) for r in boilerplate.p7_found(spark, str(tmp_path)).collect())
    assert kept() == [(i, 3) for i in range(8)]
    monkeypatch.setattr(boilerplate, "LEAST_PAGES", 99)
    assert kept() == [(i, n) for i in range(8) for n in (2, 3)]


def test_evidence_of_hosts_finds_messages(spark, tmp_path):
    """A message that no pattern knows: it is served for several addresses, or on pages apart from their addresses, and never with content."""
    from skarn.llm.residue import p5_found

    strange = "The gnomes in our cellar have taken the day off today."
    content = "<html><head><title>Mixer Alpha</title></head><body>\n<h1>Mixer Alpha</h1>\n<p>Mixer alpha stirs small volumes with care, whatever they hold.</p>\n<p>%s</p>\n</body></html>"
    message = f"<html><head><title>Shop</title></head><body>\n<p>{strange}</p>\n</body></html>"
    long = "<html><head><title>Shop</title></head><body>\n" + "".join(f"<p>{strange}</p>\n<p>Fatal error: line {w} of the program has failed.</p>\n" for w in ("a", "b", "c", "d", "e", "f")) + "</body></html>"
    bodies = [content % "It comes with a stand.", content % "The stand is sold apart from it.", message, long]
    log = [("https://v/mixer-alpha", 0, 200), ("https://v/mixer-alpha-2", 1, 404), ("https://v/pump-a", 2, 200), ("https://v/pump-b", 2, 200), ("https://v/oven-c", 3, 503)]
    _site(spark, tmp_path, bodies, log)
    assert sorted(r["fetch_id"] for r in p5_found(spark, str(tmp_path)).collect()) == [2, 3, 4]


def test_found_on_pages(spark, tmp_path):
    """Whole queries on a tiny site: bad bodies, lost bodies, null paths, repeated log lines."""
    from skarn.llm.boilerplate import p7_found
    from skarn.llm.residue import p5_found

    bodies = [(1, "b1", PAGE, 1), (2, "b2", "<html><body><h1>Error 404</h1>\n<p>Page not found</p></body></html>", 1), (3, "b3", None, 0), (4, "b4", "", 0), (5, "b5", PAGE, 1)]
    log = [(1, "v", "https://v/x", "b1"), (2, "v", "https://v/y", "b2"), (2, "v", "https://v/y", "b2"), (3, "v", "https://v/z", "gone"), (4, None, None, None), (5, "v", "https://v/w", "b5")]
    log = [(*x, 200, "live") for x in log]
    spark.createDataFrame(bodies, "body_id long, body_path string, html string, n_bytes long").write.parquet(str(tmp_path / "page_bodies.parquet"))
    spark.createDataFrame(log, "fetch_id long, vendor string, url string, body_path string, status int, source string").write.parquet(str(tmp_path / "fetch_index.parquet"))
    records = [(1, "v", "Home\nThe sensor board keeps the set temperature of 264 °C.\nAdd to cart   Compare   Share"), (2, "v", "one line"), (3, None, None)]
    spark.createDataFrame(records, "listing_id long, vendor string, description string").write.parquet(str(tmp_path / "device_records.parquet"))
    bad = [r[0] for r in p5_found(spark, str(tmp_path)).collect()]
    assert sorted(bad) == [2, 2]
    kept = {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()}
    assert {k for k in kept if k[0] == "description"} == {("description", 1, 2)}
    assert {k[2] for k in kept if k[:2] == ("body", 1)} == {6, 7, 8, 9, 10} and not {k for k in kept if k[:2] == ("body", 2)}


def test_words_of_the_corpus_show_wrong_readings(spark):
    """What looks like correct writing is found by the words that clean texts use, and only by a clear majority; also beside brute force."""
    from skarn.llm.garbled import odd_sentences

    rows = [(i, f"Kept at {i} °C. Press “Service” – then wait.") for i in range(40)] + [(100, "Kept at 7 ∞C. Press ìServiceî ñ then wait."), (101, "Optics: ∞ corrected."), (102, "El niño está aquí."), (103, None), (104, ""), (100, "Kept at 7 ∞C. Press ìServiceî ñ then wait.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(restore(t)[0] for _, t in rows if t)
    words = mend(df)
    got = {(r["doc_id"], r["sentence"]): r["reading"] for r in odd_sentences(words, "doc_id").collect()}
    assert got == {(100, 0): "cp1252 as mac_roman", (100, 1): "cp1252 as mac_roman"}
    assert odd_sentences(words.where("doc_id > 100"), "doc_id").count() == 0 and odd_sentences(words.limit(0), "doc_id").count() == 0


def test_further_scripts_and_stacked_decodings():
    for text in ("שלום עולם", "مرحبا بالعالم", "สวัสดีชาวโลก", "नमस्ते"):
        garbled = text.encode().decode("latin_1")
        assert restore(f"x {garbled} y")[1] == f"x {text} y"
    text = "Gehäuse"
    for _ in range(9):
        text = text.encode().decode("cp1252", "replace") if "�" not in text.encode().decode("cp1252", "replace") else text
    assert restore(text)[0] and restore("sch&Atilde;&frac14;tzt")[1] == "schützt"
