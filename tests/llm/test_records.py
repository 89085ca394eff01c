"""Mapping, surviving values, packing, matching: operators against brute force on small fixtures."""

import datetime
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm.mapping import map_names
from skarn.llm.matching import NEAR, RECALL, agreeing, agreement, components, group_listings, search, spanning, tune_probes
from skarn.llm.models import Names, base_of, maker_key, model_of
from skarn.llm.packing import best_fit_decreasing, lower_bound, pack
from skarn.llm.surviving import discover_truth
from skarn.llm.vectors import centroids, train
from skarn.session import cut, release


def test_mapping(spark):
    refs = spark.createDataFrame([(1, "Drying ovens", ["Trockenschränke"]), (2, "Water baths", None), (None, "x", None)], "id int, name string, aliases array<string>")
    rows = [(1, "Drying ovens", 9), (2, "drying oven", 9), (3, "Coffee machines", 9), (4, None, 9), (5, "  ", 9), (6, "Trockenschränke", 9), (7, "z" * 30000, 9), (2, "drying oven", 9)]
    got = map_names(spark.createDataFrame(rows, "row long, text string, ref_id int"), "text", refs, "id", "name", "aliases").collect()
    by = {r["row"]: (r["ref_id"], r["exact"]) for r in got}
    assert by == {1: (1, True), 2: (1, False), 3: (-1, False), 4: (None, False), 5: (None, False), 6: (1, False), 7: (-1, False)} and len(got) == 8
    assert map_names(spark.createDataFrame([], "row long, text string"), "text", refs, "id", "name", "aliases").count() == 0


SCRAPE = "product_id string, listing_id long, spec_source string, scraped_at timestamp, category string, tags array<string>"


def _at(day):
    return datetime.datetime(2024, 1, day)


STAND_INS = {None, "", " ", "k. A.", "TBD", "--"}


def _truth(rows, trust, field, rounds):
    """{product: lowest listing with the surviving value} of one field, by dictionaries."""
    kinds = [*sorted(trust), ""]
    groups = {}
    for r in rows:
        if r[0] is not None and (r[field] not in STAND_INS if field == 4 else r[field]):
            groups.setdefault(r[0], []).append((str(r[field]), r[2] if r[2] in trust else "", r[3], r[1], len(r[field].strip() if field == 4 else r[field])))
    votes = {}
    for g, own in groups.items():
        top, last = max(x[2] for x in own), {}
        for v, k, at, _, _ in own:
            last[(v, k)] = max(last.get((v, k), at), at)
        votes[g] = {v: {} for v, *_ in own}
        for (v, k), at in last.items():
            votes[g][v][(k, at == top)] = 1.0 if at == top else 1.0 / max(1, sum(kk == k for _, kk in last) - any(kk == k and t == top for (_, kk), t in last.items()))
    prior = {(k, new): (trust.get(k, 0.0) + 1) / (max(trust.values(), default=0.0) + 2) for k in kinds for new in (True, False)}
    reliability = dict(prior)

    def choose():
        out = {}
        for g, own in groups.items():
            key = lambda v: (round(sum(n * -math.log(max(1 - reliability[s], 1e-12)) for s, n in votes[g][v].items()), 9), max(x[4] for x in own if x[0] == v), -min(x[3] for x in own if x[0] == v))
            out[g] = max(votes[g], key=key)
        return out

    for _ in range(rounds):
        got = choose()
        for s in prior:
            agree = sum(votes[g][v].get(s, 0.0) for g, v in got.items())
            total = sum(w.get(s, 0.0) for of in votes.values() for w in of.values())
            reliability[s] = (agree + 2 * prior[s]) / (total + 2)
    return {g: min(x[3] for x in groups[g] if x[0] == v) for g, v in choose().items()}, reliability


def test_surviving_values(spark):
    rng = random.Random(3)
    rows = []
    for p in range(30):
        for k in range(rng.randint(1, 6)):
            rows.append((f"p{p}", len(rows), rng.choice(["page", "feed", None]), _at(k + 1), rng.choice(["a", "b", *STAND_INS]), rng.choice([None, [], ["x"], ["x", "y"]])))
    rows += [("big", 10_000 + i, "feed", _at(1 + i % 20), f"v{i % 7}", ["q"]) for i in range(500)] + [(None, 99_999, "page", _at(1), "a", ["x"])]
    df = spark.createDataFrame(rows, SCRAPE)
    trust = {"page": 4.0, "feed": 2.0}
    for rounds in (0, 1, 4):
        got, reliability = discover_truth(df, trust, fields=["category"], rounds=rounds, tolerance=0.0)
        expected, by_source = _truth(rows, trust, 4, rounds)
        assert {r["product_id"]: r["listing_id"] for r in got.collect()} == expected
        assert all(abs(reliability[(k, "newest" if new else "older")] - r) < 1e-9 for (k, new), r in by_source.items())
    got, _ = discover_truth(df, trust, fields=["category", "tags"], least_rows=2)
    found = [(r["product_id"], r["field"]) for r in got.collect()]
    several = {p for p in {r[0] for r in rows if r[0]} if sum(r[0] == p for r in rows) > 1}
    assert len(found) == len(set(found)) and {p for p, _ in found} <= several
    assert discover_truth(df.limit(0), {}, fields=["category"])[0].count() == 0


def test_recency_is_learned_and_decides(spark):
    """The rounds move rows: where trust says nothing, the newest value wins only once newest claims have proved reliable."""
    rows = [(f"p{i}", 2 * i + k, "feed", _at(1 + k), ("old", "newer")[k], None) for i in range(40) for k in range(2)]  # newer and more complete
    rows += [(f"q{i}", 1000 + 2 * i + k, "feed", _at(1 + k), ("longer", "new")[k], None) for i in range(9) for k in range(2)]  # less complete
    df, trust = spark.createDataFrame(rows, SCRAPE), {"feed": 2.0}
    survivors = lambda rounds: {r["product_id"]: r["listing_id"] for r in discover_truth(df, trust, fields=["category"], rounds=rounds)[0].collect()}
    before, after = survivors(0), survivors(20)
    assert all(before[f"q{i}"] == 1000 + 2 * i and after[f"q{i}"] == 1001 + 2 * i for i in range(9))
    assert all(before[f"p{i}"] == after[f"p{i}"] == 2 * i + 1 for i in range(40))


def _optimum(sizes, capacity):
    """Fewest bins by trying all assignments, largest first."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_packing_bounds():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 23, 60])
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(1, 9))]
        bins = best_fit_decreasing(sizes, capacity)
        used = {b: sum(s for s, x in zip(sizes, bins) if x == b) for b in bins}
        fewest = max(1, _optimum(sizes, capacity))
        counts = {s: sizes.count(s) for s in sizes}
        assert max(used.values()) <= capacity and lower_bound(counts, capacity) <= fewest <= len(used)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 40)) for i in range(400)] + [(1000, 250), (1001, 0), (1002, None), (None, 5)]
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    sizes = spark.createDataFrame([(1, 50), (2, 100)], "size_id int, capacity_tokens int")
    assignment, certificate = pack(lengths, sizes, part_items=60)
    got = assignment.collect()
    for size_id, capacity in ((1, 50), (2, 100)):
        own = [r for r in got if r["size_id"] == size_id]
        per_doc, per_bin = {}, {}
        for r in own:
            per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["tokens"]
            per_bin[r["bin"]] = per_bin.get(r["bin"], 0) + r["tokens"]
        assert per_doc == {i: n for i, n in rows if i is not None and n is not None} and max(per_bin.values()) <= capacity
        assert all(r["chunk"] == 0 for r in own if per_doc[r["doc_id"]] <= capacity) and all(per_bin[r["bin"]] == r["bin_tokens"] for r in own)
        c = [x for x in certificate.collect() if x["size_id"] == size_id][0]
        assert c["bins"] == len(per_bin) and c["lower_bound"] <= c["bins"] <= c["lower_bound"] * 1.1 + 2
    assert pack(lengths.limit(0), sizes)[0].count() == 0


def test_models():
    names = Names(["helix", "cirrus", "jovex"])
    assert base_of("Helix 5816T-230V CE") == ("helix", "5816", "T") and base_of("Iridia 3402 Plus") == ("iridia", "3402", "P") and base_of("230V") is None and base_of(None) is None
    for title, model in {"Ball mill Helix - No. 5816-T": ("helix", "5816", "T"), "3585 T Jovex": ("jovex", "3585", "T"), "HEL7533 – x": ("helix", "7533", ""), "Cirruss 1234": ("cirrus", "1234", ""), "Jovex 23-71": ("jovex", "2371", ""), "Helix, 180 litres": None, "": None}.items():
        assert names.in_title(title) == model, title
    assert names.in_description("You receive the Helix 1111. Not compatible with Helix 2222.") == ("helix", "1111", "")
    assert model_of(names, "Helix mill", None, ["Helix 5816-230V"], None)[:3] == ("helix", "5816", "") and model_of(names, None, None, None, None) == ("", "", "", "")
    assert maker_key("Solbrück GmbH") == maker_key("SOLBRÜCK") == "solbruck" and maker_key(None) == ""
    keys, values = [np.array(k, np.int32) for k in ([1, -2, 3], [1, -2, 4], [])], [np.array(v, float) for v in ([1.0, 7.0, 5.0], [1.01, 7.001, 3.0], [])]
    same, other = agreement(keys, values, np.array([0, 0]), np.array([1, 2]))
    assert same.tolist() == [1, 0] and other.tolist() == [1, 0]


def test_many_and_unknown_series():
    """Every name is kept, however many there are; a series that no designation names is read from the title."""
    many = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "um" for i in range(6000)]
    names = Names(many)
    assert all(names.in_title(f"Ball mill {s} 1234 T") == (s, "1234", "T") for s in many[::37])
    assert names.in_title("Zorbix 4711 mill") == ("zorbix", "4711", "") and names.in_title("Ball mill with 4711 ml") is None and names.in_title("Edition 2025 aaaaum") is None


def test_encoder_learns():
    rng = random.Random(4)
    words = ["mill", "mixer", "oven", "pump"]
    pair = lambda i: tuple(f"{rng.choice(['new', 'best', 'top'])} {words[i % 4]} maker{i % 7} helix {1000 + i}" for _ in range(2))
    encoder = train([pair(i) for i in range(400)])
    a, b = zip(*[pair(i) for i in range(400, 500)])
    alike = encoder.encode(list(a)) @ encoder.encode(list(b)).T
    assert (alike.argmax(1) == np.arange(100)).mean() > 0.9
    assert encoder.encode([""]).shape == (1, 64) and centroids(np.zeros((0, 64), np.float32), 4).shape[0] == 1


def test_components(spark):
    rng = random.Random(6)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + list(zip(chain, chain[1:]))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


RECORDS = "product_id string, listing_id long, vendor string, manufacturer string, name string, category string, description string, specs map<string,string>, source_variants array<string>, scraped_at timestamp"


def test_groups(spark):
    rows = []

    def add(pid, maker, name, category="Ball mills", specs=None, variants=None, text=None):
        rows.append((pid, len(rows), "v", maker, name, category, text, specs, variants, _at(1)))

    for i in range(12):
        n = 1000 + 37 * i
        add(f"a{i}", "Korvand", f"Ball mill Helix {n}", variants=[f"Helix {n}-230V"])
        add(f"b{i}", "KORVAND GmbH" if i % 3 else None, f"Kugelmühle Korvand Helix-{n} Top price!", variants=[f"Helix {n}-120V"])
        add(f"c{i}", "Korvand", f"Helix {n} T ball mill", variants=[f"Helix {n}T-230V"])
        add(f"d{i}", "Vossmark", f"Helix {n} titrator", category="Titrators")
    add("a0", "Korvand", "Ball mill Helix 1000")
    add("e", "Korvand", "Korvand Helix ball mill", specs={"power": "2 kW", "slots": "28"})
    add("f", "Korvand", "Helix 7777 ball mill", specs={"power": "2000 W", "slots": "28 x"})
    add("g", None, None, None)
    add(None, "x", "y")
    groups, info = group_listings(spark.createDataFrame(rows, RECORDS), {"power": "W"})
    by = {r["product_id"]: r["group"] for r in groups.collect()}
    assert set(by) == {r[0] for r in rows if r[0]}
    sets = {}
    for p, g in by.items():
        sets.setdefault(g, set()).add(p)
    assert {frozenset(s) for s in sets.values() if len(s) > 1} == {frozenset((f"a{i}", f"b{i}")) for i in range(12)} | {frozenset("ef")}
    assert info["recall_numbered"] >= 0.9 and info["recall_unnumbered"] >= 0.9
    assert group_listings(spark.createDataFrame([], RECORDS), {})[0].count() == 0


def test_copies_without_a_number(spark):
    """Listings without a model number that score alike don't keep each other from their numbered model, nor join two models."""
    rows = []

    def add(pid, name, specs=None, variants=None):
        rows.append((pid, len(rows), "v", "Korvand", name, "Ball mills", None, specs, variants, _at(1)))

    for i in range(12):
        add(f"n{i}", f"Helix {1000 + 37 * i} ball mill", {"power": f"{i + 2} kW", "slots": str(20 + i)}, [f"Helix {1000 + 37 * i}-230V"])
    for k in range(4):
        add(f"copy{k}", "Korvand Helix ball mill", {"power": "2 kW", "slots": "20"})
        add(f"sibling{k}", f"Korvand Helix ball mill {'!' * k} offer {'abcd'[k] * 4}", {"slots": "21 x", "power": "3000 W", **({"weight": "9 kg"} if k else {})})
    groups, _ = group_listings(spark.createDataFrame(rows, RECORDS), {"power": "W"})
    sets = {}
    for r in groups.collect():
        sets.setdefault(r["group"], set()).add(r["product_id"])
    assert {frozenset(x) for x in sets.values() if len(x) > 1} == {frozenset(["n0", *(f"copy{k}" for k in range(4))]), frozenset(["n1", *(f"sibling{k}" for k in range(4))])}


def _packed(rows):
    return np.rint(np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True) * 127).astype(np.int8)


def test_spanning_forest_connects_what_all_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        v = _packed(rng.standard_normal((n, 4))).astype(np.float32) / 127
        maker, category, home = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.random(n) < 0.6
        pairs = [(i, j) for i in range(n) for j in range(i) if v[i] @ v[j] >= NEAR and (home[i] or home[j]) and agreeing(maker, category, np.array([i]), np.array([j]))[0]]
        got = spanning(v, maker, category, home)

        def parts(links):
            of = list(range(n))
            for i, j in links:
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
            return {frozenset(k for k in range(n) if of[k] == x) for x in set(of)}

        assert parts(pairs) == parts([(i, j) for i, j, _ in got]) and len(got) < n
        for i in range(n):  # the most alike partner of every row is among the pairs
            own = [v[i] @ v[j] for a, b in pairs for j in ([b] if a == i else [a] if b == i else [])]
            assert not own or abs(max(own) - max(s for a, b, s in got if i in (a, b))) < 1e-5


def test_search_finds_what_probed_lists_hold(spark):
    """Against brute force: with all lists probed, and with the tuned number at least RECALL of the pairs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(240):
        k = i % 30
        rows.append((i, bytes(_packed([base[k] + 0.5 * rng.standard_normal(16)])), bytes(_packed([base[k]])), 1 + k % 2, 1, 1 + k % 9 if i < 200 else 0, 1, b"", b""))
    index = spark.createDataFrame(rows, "class long, v binary, w binary, maker long, series long, model long, category long, keys binary, values binary")
    centre = centroids(np.stack([np.frombuffer(r[1], np.int8) / 127 for r in rows]).astype(np.float32), 8)
    numbered = [r for r in rows if r[5]]
    v = {r[0]: np.frombuffer(r[1], np.int8).astype(np.float32) / 127 for r in rows}
    exact = [(a[0], b[0]) for a in numbered for b in numbered if a[0] < b[0] and a[5] == b[5] and a[3] == b[3] and v[a[0]] @ v[b[0]] >= NEAR]
    probes, recall = tune_probes(index, centre, "v", True)
    assert recall >= RECALL and probes <= 8
    for n in (8, probes):
        found = components(search(index, centre, n).select("a", "b"))
        of = {r["node"]: r["component"] for r in found.collect()}
        assert sum(of.get(a, -1) == of.get(b, -2) for a, b in exact) >= RECALL * len(exact)
    assert tune_probes(index.where("model = 0").limit(1), centre, "w", False) == (8, None) and tune_probes(index.limit(0), centre, "v", True) == (8, None)


def _shuffled(plan):
    """Records that the exchanges of a plan wrote when it ran."""
    inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else ""
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(map(_shuffled, children))


def _random_index(spark, n, models):
    """An index of n rows, a tenth of them without a number, and 16 centroids."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((models, 16))
    facts = lambda i: (np.array([1, 2, 3], np.int32).tobytes(), np.array([i % models, i % 5, i % 3], np.float64).tobytes())
    rows = [(i, bytes(_packed([base[i % models] + 0.7 * rng.standard_normal(16)])), bytes(_packed([base[i % models]])), 1 + i % 2, 1, 1 + i % models if i % 10 else 0, 1, *facts(i)) for i in range(n)]
    index = spark.createDataFrame(rows, "class long, v binary, w binary, maker long, series long, model long, category long, keys binary, values binary")
    return index, centroids(np.stack([np.frombuffer(r[1], np.int8) / 127 for r in rows]).astype(np.float32), 16)


def test_search_shuffles_a_row_once(spark):
    """However many lists a row probes, it is shuffled once: copies for each list took more disk than there is."""
    index, centre = _random_index(spark, 2000, 700)
    written = {}
    for probes in (1, 16):
        found = search(index, centre, probes)
        found.collect()
        written[probes] = _shuffled(found._jdf.queryExecution().executedPlan())
    assert written[1] < 4 * 2000 and written[16] < written[1] + 2 * 2000


def test_search_in_parts(spark, monkeypatch):
    """Numbers cut into parts, blocks cut into pieces and short blocks give what whole ones give."""
    from skarn.llm import matching

    index, centre = _random_index(spark, 600, 7)
    numbered = lambda: sorted(map(tuple, search(index, centre, 5).collect()))
    words = lambda: {tuple(r) for r in matching.search_by_words(index, centre, 5).where("model = 0").select("x", "y", "score").collect()}
    whole, by_words = numbered(), words()
    assert whole and by_words
    monkeypatch.setattr(matching, "HOT", 10)
    monkeypatch.setattr(matching, "PAIRS", 40)
    assert numbered() == whole and words() == by_words
    monkeypatch.setattr(matching, "BLOCK", 16)
    assert words() >= by_words


def test_release(spark):
    """What nothing reads any more leaves the disk at once; what was made of it stays."""
    first = cut(spark.range(100).toDF("x"))
    second = cut(first.groupBy((F.col("x") % 7).alias("y")).count())
    of = lambda df: df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    paths = of(first), of(second)
    assert all(map(os.path.exists, paths))
    release(first)
    assert [os.path.exists(p) for p in paths] == [False, True] and second.count() == 7


def test_encoder_decides_without_series(spark, monkeypatch):
    """The method moves rows: models of one maker and number whose series no list knows are told apart by the trained encoder."""
    from skarn.llm import matching

    rows = []
    kinds = ["ball mill", "titrator", "water bath", "gas generator", "viscometer", "autoclave"]
    words = [["quiet", "leiser"], ["digital", "digitaler"], ["new", "neu"]]
    for i in range(240):
        for k in range(2):
            title = f"{words[i % 3][k]} {kinds[i % 6]} {'zorbix' if i % 2 else 'qualnet'} {1000 + i // 2}{[' offer', ' ready to ship'][k]}"
            rows.append((f"{'ab'[k]}{i}", len(rows), "v", "Korvand", title, kinds[i % 6], None, None, None, _at(1)))
    df = spark.createDataFrame(rows, RECORDS)

    def right():
        by = {r["product_id"]: r["group"] for r in group_listings(df, {})[0].collect()}
        sizes = {}
        for g in by.values():
            sizes[g] = sizes.get(g, 0) + 1
        return sum(by[f"a{i}"] == by[f"b{i}"] and sizes[by[f"a{i}"]] == 2 for i in range(240))

    trained = right()
    monkeypatch.setattr(matching, "train", lambda pairs: train([]))
    assert trained >= 0.95 * 240 and right() < trained


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_bins", "p10_found"])
def test_queries_have_their_columns(spark, small, name):
    from skarn.llm.catalog import queries

    columns = {
        "p2_found": ["product_id_a", "product_id_b"], "p3_found": ["field", "row_id", "ord", "ref_id"], "p5_found": ["fetch_id"], "p6_found": ["product_id", "field", "listing_id"], "p7_found": ["src", "row_id", "line_no"],
        "p8_ids": ["doc_id", "ids"], "p9_bins": ["size_id", "doc_id", "chunk", "tokens", "bin", "bin_tokens"], "p10_found": ["doc_id"],
    }
    df = queries()[name](spark, small)
    assert df.columns == columns[name] and df.count() > 0
