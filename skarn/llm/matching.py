"""Problem 2: listings of one product, grouped across vendors.

Titles are encoded by a contrastively trained subword encoder and searched through an inverted file whose number of
probes is tuned against exact neighbours. Neighbours are vetoed only by contradiction: another number or suffix, another
maker. That two titles of one number name one series is left to the encoder, so series that no list knows are matched
too. What is left is grouped over mutual neighbours. Listings without a model number are searched by the words of their
title, vetoed by another series or category, and matched by the agreement of their specifications with a neighbour's.
"""

from __future__ import annotations

import json
import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.cells import is_real
from skarn.llm.models import Names, base_of, maker_key, model_of
from skarn.llm.vectors import centroids, train
from skarn.operators.quantities import read_quantity
from skarn.session import cut, fresh, read_table, release, ship_package, spread

log = logging.getLogger(__name__)
#: Bounds of what is gathered for fitting: training pairs, vectors for the centroids (at most), queries of either kind for tuning the probes.
TRAIN_PAIRS, CENTROID_SAMPLE, TUNING_QUERIES = 4000, 40_000, 400
#: Series and makers are names of the trade; more distinct ones than this don't fit a broadcast and are an error.
MOST_NAMES = 300_000
#: Rows of an inverted list that the number of lists aims at, most lists, and rows of a search block; longer lists are cut into several.
LIST_ROWS, MOST_LISTS, BLOCK = 32, 4096, 16_384
#: Pairs of rows of a block that are compared at a time.
PAIRS = 1 << 22
#: Rows in lists that one call of a search function gets: several blocks, since a call costs more than a short list.
BUNDLE = 16_384
#: Rows of one model number that are held together; more are cut by the lists they probe.
HOT = 65_536
#: Least similarity of candidates with a model number, by words alone, and share of exact neighbours that the probes must find.
NEAR, NEAR_WORDS, RECALL = 0.4, 0.5, 0.995
#: How much less alike than its nearest neighbour a mutual neighbour may be.
MARGIN = 0.4
# Categories that say nothing about the product.
GENERAL = ["other", "products", "laboratory", "shop", "details", "catalogue", "all"]


def _names(column: DataFrame, what: str) -> list[str]:
    """The distinct names of a column; an error over MOST_NAMES."""
    found = [r[0] for r in column.where(F.col("name") != "").distinct().limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} {what}: shard the records by category")
    return found


def _series(records: DataFrame) -> list[str]:
    """The series names that designations use."""
    ship_package(records.sparkSession)

    def bases(variants: pd.Series, designation: pd.Series) -> pd.Series:
        out = []
        for vs, d in zip(variants, designation):
            found = {b[0] for b in map(base_of, [*(vs if vs is not None else []), d]) if b}
            out.append(sorted(found))
        return pd.Series(out, index=variants.index)

    return _names(records.select(F.explode(F.pandas_udf(bases, "array<string>")("source_variants", F.col("specs")["type_designation"])).alias("name")), "series")


def products(records: DataFrame) -> DataFrame:
    """product_id, title, maker, series, number, suffix, category, specs: one row per product over its repeated scrapes.

    Each field comes from the newest scrape that has it. Products with a null id are left out.
    """
    ship_package(records.sparkSession)
    records = records.where(F.col("product_id").isNotNull())
    names = records.sparkSession.sparkContext.broadcast(Names(_series(records)))

    def read(name: pd.Series, maker: pd.Series, designation: pd.Series, variants: pd.Series, description: pd.Series) -> pd.DataFrame:
        rank = {"designation": 4, "title": 3, "variants": 2, "description": 1, "": 0}
        got = [(*(m := model_of(names.value, n, d, v, t))[:3], rank[m[3]], maker_key(k)) for n, k, d, v, t in zip(name, maker, designation, variants, description)]
        return pd.DataFrame(got, columns=["series", "number", "suffix", "rank", "maker"], index=name.index)

    facts = F.pandas_udf(read, "struct<series string, number string, suffix string, rank int, maker string>")
    df = spread(records.select("product_id", "name", "manufacturer", "category", "specs", "source_variants", "description", "scraped_at"))
    df = df.withColumn("f", facts("name", "manufacturer", F.col("specs")["type_designation"], "source_variants", "description"))
    named = is_real(F.col("category")) & ~F.lower(F.trim("category")).isin(*GENERAL)
    return df.groupBy("product_id").agg(
        F.max_by("name", F.when(is_real(F.col("name")), F.col("scraped_at"))).alias("title"),
        F.max_by("f.maker", F.when(F.col("f.maker") != "", F.col("scraped_at"))).alias("maker"),
        F.max_by(F.struct("f.series", "f.number", "f.suffix"), F.struct("f.rank", F.col("scraped_at"))).alias("m"),
        F.max_by("category", F.when(named, F.col("scraped_at"))).alias("category"),
        F.max_by(F.to_json("specs"), F.struct(F.size("specs"), F.col("scraped_at"))).alias("specs"),
    ).select("product_id", "title", F.coalesce("maker", F.lit("")).alias("maker"), "m.series", "m.number", "m.suffix", F.coalesce(F.lower(F.trim("category")), F.lit("")).alias("category"), "specs")


def with_maker(df: DataFrame, makers: list[str]) -> DataFrame:
    """Fills a missing maker from the title, by the makers that other rows name; their number is bounded by MOST_NAMES."""
    known = df.sparkSession.sparkContext.broadcast(set(makers))

    def find(title: pd.Series, maker: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(title, maker):
            if not m and t:
                m = next((k for k in (maker_key(w) for w in t.replace("(", " ").replace(")", " ").split()) if k in known.value), "")
            out.append(m)
        return pd.Series(out, index=title.index)

    return df.withColumn("maker", F.pandas_udf(find, "string")("title", "maker"))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): products whose title, maker, model and category are alike are one class.

    Without a model number at least two real specifications, all equal, take its place.
    """
    text = F.concat_ws(" ", "title", "maker", F.concat("series", F.lit(" "), "number", F.lit(" "), "suffix"), F.concat("series", "number"))
    alike = [F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\W_]+", " ")), "maker", "series", "number", "suffix", "category"]
    entries = F.array_sort(F.map_entries(F.from_json("specs", "map<string,string>")))
    described = F.size(F.filter(entries, lambda e: is_real(e["value"]))) >= 2
    keyed = rows.withColumn("text", text).withColumn("class", F.when(F.col("number") != "", F.xxhash64(*alike)).when(described, F.xxhash64(*alike, entries)).otherwise(F.xxhash64("product_id", F.lit("single"))))
    representatives = keyed.groupBy("class").agg(*[F.min(c).alias(c) for c in ("text", "title", "maker", "series", "number", "suffix", "category", "specs")])
    return representatives, keyed.select("product_id", "class")


def _training_pairs(rows: DataFrame) -> list[tuple[str, str]]:
    """Titles of different classes with one maker and model: the first and the last of each model, up to TRAIN_PAIRS models."""
    models = rows.where((F.col("number") != "") & (F.col("maker") != "")).groupBy("maker", "series", "number", "suffix").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return [(r[0], r[1]) for r in models.where("a != b").orderBy(F.xxhash64("a")).select("a", "b").limit(TRAIN_PAIRS).collect()]



def hash_code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) >> 1 if text else 0


def vectors_of(rows: DataFrame, encoder, units: dict[str, str]) -> DataFrame:
    """class, v and w (vectors of the title, whole and by its words alone, as signed bytes), the codes that veto (maker,
    series, model, category; 0 where unknown), and keys and values of the comparable specifications."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def encode(text: pd.Series, maker: pd.Series, series: pd.Series, number: pd.Series, suffix: pd.Series, category: pd.Series, specs: pd.Series) -> pd.DataFrame:
        packed = lambda words: [x.tobytes() for x in np.rint(shared.value.encode(text.tolist(), words) * 127).astype(np.int8)]
        known = [_facts(x, units) for x in specs]
        return pd.DataFrame({
            "v": packed(False), "w": packed(True), "maker": [hash_code(x or "") for x in maker], "series": [hash_code(x or "") for x in series], "model": [hash_code(f"{n}/{x or ''}") if n else 0 for n, x in zip(number, suffix)], "category": [hash_code(x or "") for x in category],
            "keys": [np.array(list(f), np.int32).tobytes() for f in known], "values": [np.array(list(f.values()), np.float64).tobytes() for f in known],
        }, index=text.index)

    udf = F.pandas_udf(encode, "struct<v binary, w binary, maker bigint, series bigint, model bigint, category bigint, keys binary, values binary>")
    return rows.withColumn("e", udf("text", "maker", "series", "number", "suffix", "category", "specs")).select("class", "e.*")


def unpacked(column: pd.Series) -> np.ndarray:
    """Vectors from signed bytes."""
    return np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1).astype(np.float32) / 127


CODES = ["maker", "series", "model", "category"]


def agreeing(maker: np.ndarray, category: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows the vetoes on makers let pass: makers must not contradict; a missing maker needs the category."""
    same = maker[i] == maker[j]
    return same & (maker[i] != 0) | ((maker[i] == 0) | (maker[j] == 0)) & (category[i] == category[j]) & (category[i] != 0)


def contradicting(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) have different codes, both known."""
    return (codes[i] != codes[j]) & (codes[i] != 0) & (codes[j] != 0)


def tune_probes(index: DataFrame, centre: np.ndarray, column: str, numbered: bool) -> tuple[int, float | None]:
    """(probes, recall) of queries with a model number or without: the fewest probes that find RECALL of the exact
    neighbours of a bounded set of queries.

    The exact neighbours come from comparing the queries with every row, block by block where the rows lie. Without any
    neighbour there is no recall (None) and all lists are probed.
    """
    kind = F.col("model") != 0 if numbered else F.col("model") == 0
    sample = index.where(kind).orderBy(F.xxhash64("class", F.lit(1))).limit(TUNING_QUERIES).select("class", column, *CODES).toPandas()
    if sample.empty:
        return len(centre), None
    shared = index.sparkSession.sparkContext.broadcast((sample, centre))

    def compare(blocks):
        queries, middle = shared.value
        n, qv = len(queries), unpacked(queries[column])
        order = np.argsort(-(qv @ middle.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(n, 0), axis=1)
        for pdf in blocks:
            if len(pdf):
                dv = unpacked(pdf[column])
                codes = {c: np.concatenate([queries[c].to_numpy(np.int64), pdf[c].to_numpy(np.int64)]) for c in [*CODES, "class"]}
                near = qv @ dv.T >= (NEAR if numbered else NEAR_WORDS)
                if numbered:
                    near &= codes["model"][:n, None] == codes["model"][None, n:]
                i, j = np.nonzero(near)
                ok = agreeing(codes["maker"], codes["category"], i, j + n) & (codes["class"][i] != codes["class"][j + n])
                if not numbered:
                    ok &= ~contradicting(codes["series"], i, j + n) & ~contradicting(codes["category"], i, j + n)
                home = (dv @ middle.T).argmax(1)
                yield pd.DataFrame({"place": place[i[ok], home[j[ok]]]})

    counts = index.select("class", column, *CODES).mapInPandas(compare, "place int").groupBy("place").count().orderBy("place").collect()
    total, seen = sum(n for _, n in counts), 0
    for place, n in counts:
        seen += n
        if seen >= RECALL * total:
            return place + 1, seen / total
    return len(centre), None


def _placed(index: DataFrame, centre: np.ndarray, column: str, probes) -> DataFrame:
    """Adds lists: the numbers of the nearest centroids, the row's own list first. probes: Column, how many."""
    middle = index.sparkSession.sparkContext.broadcast(centre)

    def nearest(v: pd.Series, n: pd.Series) -> pd.Series:
        alike = unpacked(v) @ middle.value.T
        return pd.Series([np.argsort(-a)[:k] if k > 1 else np.array([a.argmax()]) for a, k in zip(alike, n)], index=v.index)

    return index.withColumn("lists", F.pandas_udf(nearest, "array<int>")(column, probes))


def _blocks(placed: DataFrame) -> DataFrame:
    """list, parts: how many blocks of about BLOCK the rows that lie in or ask a list make; one row per centroid."""
    return F.broadcast(placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK))).cast("int").alias("parts")))


def _bundles(rows: DataFrame, lists: int = 1) -> int:
    """How many bundles of about BUNDLE rows a frame makes whose rows are met in so many lists each."""
    return max(1, -(-rows.count() * lists // BUNDLE))


def _spans(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values in sorted columns."""
    n = len(columns[0])
    changes = np.zeros(n, bool)
    for c in columns:
        changes[1:] |= c[1:] != c[:-1]
    changes[:1] = True
    starts = np.flatnonzero(changes)
    return list(zip(starts, np.r_[starts[1:], n]))


def spanning(v: np.ndarray, maker: np.ndarray, category: np.ndarray, home: np.ndarray) -> list[tuple[int, int, float]]:
    """The most alike pairs that connect rows of one model number as all allowed pairs do: a greatest spanning forest.

    Pairs must be at least NEAR alike, pass the makers' vetoes and have a row whose own list this is. Every row's best
    pair is among them; n rows give fewer than n pairs, never all.
    """
    n = len(v)
    rows = np.arange(n)
    best, parent, done = np.full(n, -1.0, np.float32), np.full(n, -1), np.zeros(n, bool)
    out = []
    for _ in range(n):  # Prim's algorithm, a vector at a time; a new tree begins where nothing is reached
        at = int(np.where(done, -2.0, best).argmax())
        if parent[at] >= 0:
            out.append((int(parent[at]), at, float(best[at])))
        done[at] = True
        alike = v @ v[at]
        here = np.full(n, at)
        better = ~done & (alike >= NEAR) & (alike > best) & (home | home[at]) & agreeing(maker, category, here, rows)
        best[better], parent[better] = alike[better], at
    return out


def search(index: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """a, b, similarity of pairs of classes a < b with one model number that a probed list joins, NEAR alike and not vetoed.

    Rows lie in the list of their nearest centroid and query the lists of their probes nearest ones. Rows meet by model
    number first and by list inside the task, so a row is shuffled once, without the lists that it probes. A number of
    over HOT rows is cut by the lists into parts, and a row goes to the parts that it probes, with its lists there. No pair
    is missed, and inside a list each number gives a spanning forest of its rows instead of all its pairs.
    """
    rows = index.where(F.col("model") != 0).select("class", "v", *CODES)
    hot = rows.groupBy("model").agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("parts")).where("parts > 1")
    sized = rows.join(F.broadcast(hot), "model", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # at most one of HOT rows is hot
    placed = _placed(sized, centre, "v", F.when(F.col("parts") > 1, probes).otherwise(1)).withColumn("lists", F.col("lists").cast("array<smallint>"))
    within = lambda x: F.pmod(x.cast("int"), F.col("parts"))
    parted = placed.withColumn("home", F.col("lists")[0]).withColumn("part", F.explode(F.array_distinct(F.transform("lists", within))))
    parted = parted.withColumn("lists", F.filter("lists", lambda x: within(x) == F.col("part")))
    bundle = F.pmod(F.xxhash64("model", "part"), F.lit(_bundles(rows, probes))).cast("int")
    middle = index.sparkSession.sparkContext.broadcast(centre)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["model", "part", "class"], ignore_index=True)
        v, maker, category, names, home, lists, parts = unpacked(pdf["v"]), *(pdf[c].to_numpy() for c in ("maker", "category", "class", "home", "lists", "parts"))
        got = []
        for a, b in _spans(pdf["model"].to_numpy(), pdf["part"].to_numpy()):
            if b - a == 1:
                continue
            probed = np.zeros((b - a, len(middle.value)), bool)  # at most about HOT x MOST_LISTS bytes
            for at in range(a, b, 1024) if parts[a] == 1 else ():
                end = min(b, at + 1024)
                near = np.argpartition(-(v[at:end] @ middle.value.T), probes - 1, axis=1)[:, :probes]
                np.put_along_axis(probed[at - a : end - a], near, True, axis=1)
            for k in range(a, b):
                probed[k - a, lists[k]] = True
            for own in np.unique(home[a:b]):
                at = a + np.flatnonzero(probed[:, own])
                if len(at) > 1:
                    got += [(names[at[i]], names[at[j]], s) for i, j, s in spanning(v[at], maker[at], category[at], home[at] == own)]
        return pd.DataFrame([(min(i, j), max(i, j), s) for i, j, s in got if i != j], columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float32"})

    rows = parted.select(bundle.alias("bundle"), "class", "v", "maker", "category", "model", "home", "lists", "parts", "part")
    pairs = rows.groupBy("bundle").applyInPandas(meet, "a bigint, b bigint, similarity float")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _facts(specs: str | None, units: dict[str, str]) -> dict[int, float]:
    """Comparable values of a product's specifications by a number for the attribute: amounts in common units and whole
    numbers, which may differ a little; negative numbers are of dates, which must be equal."""
    out: dict[int, float] = {}
    for key, raw in (json.loads(specs) if specs else {}).items():
        text, number = " ".join((raw or "").split()), hash_code(key) % (1 << 30) + 1
        if key in units:
            got = read_quantity(units[key], False, text, None, None, None)
            if got:
                out[number] = got[0] * got[3] + got[4]
        elif text and any(ch.isalnum() for ch in text):
            digits = "".join(ch if ch.isdigit() else " " for ch in text).split()
            if key.endswith("_date") and len(digits) == 3:
                out[-number] = float(hash_code("-".join(sorted(d.lstrip("0") for d in digits))) % (1 << 50))
            elif digits and text.replace(".0", "").replace("up to", "").strip().split()[0].isdigit():
                out[number] = float(text.replace(".0", "").replace("up to", "").strip().split()[0])
    return out


def agreement(keys: list, values: list, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that agree, values that differ) of each pair (i, j) of rows; amounts agree within 1.5 %, dates if they are equal."""
    names, where = np.unique(np.concatenate([np.empty(0, np.int32), *keys]), return_inverse=True)
    table = np.full((len(keys), max(1, len(names))), np.nan)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    table[owner, where] = np.concatenate([np.empty(0), *values])
    x, y = table[i], table[j]
    both = ~(np.isnan(x) | np.isnan(y))
    near = np.abs(x - y) <= np.where(np.r_[names < 0, [False] * (table.shape[1] - len(names))], 0.0, 0.015) * np.maximum(np.maximum(np.abs(x), np.abs(y)), 1e-9)
    return (both & near).sum(1), (both & ~near).sum(1)


SCORED = "x bigint, y bigint, model bigint, similarity float, score double"


def search_by_words(index: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """x, y, model, similarity, score: for each class x without a model number the best neighbours y of a search by words.

    Of a block's rows that are NEAR_WORDS alike and not vetoed, those of the two best scored models are kept, one each,
    and those without a number that score best of their kind. A value that agrees counts 1, one that differs -1.5. Long
    lists are cut into blocks of about BLOCK rows, and queries likewise, so that no task holds a whole hot list; every
    block is shuffled to every block of its list's queries, so blocks are as long as a task can hold and are compared
    PAIRS at a time.
    """
    unnumbered = F.col("model") == 0
    placed = cut(_placed(index.select("class", "w", *CODES, "keys", "values"), centre, "w", F.when(unnumbered, probes).otherwise(1)))
    columns = ["list", "block", "part", "class", "w", *CODES, "keys", "values"]
    asking, lying = placed.where(unnumbered), placed.withColumn("list", F.col("lists")[0])
    blocks = lying.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK))).cast("int").alias("blocks"))
    plan = F.broadcast(_blocks(asking).join(blocks, "list"))  # one row per centroid
    rows = lying.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = asking.withColumn("list", F.explode("lists")).join(plan, "list")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    both = queries.select(F.lit(True).alias("asks"), *columns).unionByName(rows.select(F.lit(False).alias("asks"), *columns))
    both = both.withColumn("bundle", F.pmod(F.xxhash64("list", "block", "part"), F.lit(_bundles(both))).cast("int"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "block", "part", "asks"], kind="stable", ignore_index=True)
        asks = pdf["asks"].to_numpy()
        out = [pd.DataFrame({"x": [], "y": [], "model": [], "similarity": [], "score": []}).astype({"x": "int64", "y": "int64", "model": "int64", "similarity": "float32", "score": "float64"})]
        for a, b in _spans(*(pdf[c].to_numpy() for c in ("list", "block", "part"))):
            middle = a + int((~asks[a:b]).sum())
            step = max(1, PAIRS // max(1, middle - a))
            out += [best(pdf.iloc[at : min(b, at + step)], pdf.iloc[a:middle]) for at in range(middle, b, step) if a < middle]
        return pd.concat(out, ignore_index=True)

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        n = len(q)
        alike = unpacked(q["w"]) @ unpacked(d["w"]).T
        i, j = np.nonzero(alike >= NEAR_WORDS)
        code = {c: np.concatenate([q[c].to_numpy(np.int64), d[c].to_numpy(np.int64)]) for c in [*CODES, "class"]}
        ok = agreeing(code["maker"], code["category"], i, j + n) & ~contradicting(code["series"], i, j + n) & ~contradicting(code["category"], i, j + n) & (code["class"][i] != code["class"][j + n])
        i, j = i[ok], j[ok]
        of = lambda c, t: [np.frombuffer(x, t) for x in [*q[c], *d[c]]]
        same, other = agreement(of("keys", np.int32), of("values", np.float64), i, j + n)
        out = pd.DataFrame({"x": code["class"][i], "y": code["class"][j + n], "model": code["model"][j + n], "similarity": alike[i, j], "score": same - 1.5 * other})
        out = out.sort_values(["x", "score", "similarity", "y"], ascending=[True, False, False, True], ignore_index=True)
        numbered = out[out["model"] != 0].drop_duplicates(["x", "model"]).groupby("x").head(2)
        siblings = out[out["model"] == 0]
        siblings = siblings[siblings["score"] == siblings.groupby("x")["score"].transform("max")]
        return pd.concat([numbered, siblings], ignore_index=True)

    found = cut(both.groupBy("bundle").applyInPandas(meet, SCORED))
    release(placed)
    return found


def unnumbered_links(scored: DataFrame) -> DataFrame:
    """a, b of classes of which at least one has no model number, by agreeing specifications.

    The best numbered model must reach 2 and beat every other numbered model; 1 is enough if every other one's values
    contradict. Neighbours without a number are not rivals: those that score best of all, 2 at least, are linked too, all
    of a tie, unless that would join two numbered models.
    """
    by_model = scored.where(F.col("model") != 0).groupBy("x", "model").agg(F.max(F.struct("score", "similarity", "y")).alias("m"))
    order = Window.partitionBy("x").orderBy(F.desc("m.score"), F.desc("m.similarity"), "m.y")  # at most two rows a list that x probes
    ranked = by_model.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("m.score").over(order)).where(F.col("rank") == 1)
    clear = F.col("next").isNull() | (F.col("m.score") > F.col("next"))
    alone = (F.col("m.score") >= 1) & (F.coalesce(F.col("next"), F.lit(-9.0)) <= -1.5)
    chosen = cut(ranked.where(clear & ((F.col("m.score") >= 2) | alone)).select("x", F.col("m.y").alias("y"), "model"))
    top = scored.groupBy("x").agg(F.max("score").alias("top"))
    siblings = scored.where((F.col("model") == 0) & (F.col("score") >= 2)).join(top, "x").where(F.col("score") == F.col("top")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    own = chosen.select(F.col("x").alias("node"), F.col("model").alias("own"))
    joined = components(siblings).join(own, "node", "left")
    mixed = joined.groupBy("component").agg(F.count_distinct("own").alias("models"))
    facts_of = cut(joined.join(mixed, "component").select("node", "own", "models"))
    both = siblings.join(facts_of.withColumnRenamed("node", "a").withColumnRenamed("own", "own_a"), "a").join(facts_of.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    agreeing_ = both.where((F.col("models") <= 1) | (F.col("own_a") == F.col("own_b"))).select("a", "b")
    return chosen.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(agreeing_)


def mutual(pairs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Pairs in which each is a neighbour of the other: no further than margin below its nearest one."""
    sides = pairs.select(F.col("a").alias("x"), "similarity").unionByName(pairs.select(F.col("b").alias("x"), "similarity"))
    top = sides.groupBy("x").agg(F.max("similarity").alias("top"))
    near = pairs.join(top.withColumnRenamed("x", "a").withColumnRenamed("top", "ta"), "a").join(top.withColumnRenamed("x", "b").withColumnRenamed("top", "tb"), "b")
    return near.where((F.col("similarity") >= F.col("ta") - margin) & (F.col("similarity") >= F.col("tb") - margin)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of the links.

    Every node joins its least neighbour, if that is less than itself, and the links are drawn anew between what the nodes
    joined, until none is left. Each round leaves at most half of the nodes that have links, so the rounds grow with the
    logarithm of the graph, whatever its shape, and their links shrink.
    """
    edges = fresh(cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    least = lambda e: e.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
    label = fresh(cut(least(edges).withColumnRenamed("to", "component")))
    while True:
        joined = least(edges)
        ends = edges.join(joined.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(joined.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = fresh(cut(ends.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
        if edges.isEmpty():
            return label
        label = fresh(cut(label.join(least(edges).select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))))


def _lists(index: DataFrame, column: str, total: int) -> np.ndarray:
    """Centroids, one per LIST_ROWS rows and at most MOST_LISTS, from a bounded sample."""
    lists = max(4, min(MOST_LISTS, total // LIST_ROWS))
    wanted = min(CENTROID_SAMPLE, 10 * lists)
    share = min(1.0, wanted * 1.2 / total)
    sample = index.select(column) if share >= 1 else index.where(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).select(column)
    return centroids(unpacked(sample.limit(wanted).toPandas()[column]), lists)


def group_listings(records: DataFrame, units: dict[str, str]) -> tuple[DataFrame, dict]:
    """(product_id, group of every product; facts of the search).

    records: product_id, name, manufacturer, category, description, specs, source_variants, scraped_at. Products alike in
    title, maker, model and category are one class and are searched once. Products without a title or any word in common
    with another stay alone. Every row is indexed; the encoder, the centroids and the probes are fitted on bounded samples
    (TRAIN_PAIRS, CENTROID_SAMPLE, TUNING_QUERIES). An empty table gives an empty result.
    """
    rows = cut(products(records))
    release()
    makers = _names(rows.select(F.col("maker").alias("name")), "makers")
    named = cut(with_maker(rows, makers))
    release(rows)
    representatives, membership = map(cut, classes(named))
    release(named)
    encoder = train(_training_pairs(representatives))
    index = cut(vectors_of(spread(representatives), encoder, units))
    release(representatives)
    kinds = {r[0]: r[1] for r in index.groupBy(F.col("model") != 0).count().collect()}
    facts: dict = {"classes": sum(kinds.values())}
    links = None
    for numbered, column, find in ((True, "v", lambda c, p: mutual(cut(search(index, c, p)))), (False, "w", lambda c, p: unnumbered_links(search_by_words(index, c, p)))):
        if not kinds.get(numbered):
            continue
        lying = index.where(F.col("model") != 0) if numbered else index
        centre = _lists(lying, column, kinds[True] if numbered else facts["classes"])
        probes, recall = tune_probes(lying, centre, column, numbered)
        name = "numbered" if numbered else "unnumbered"
        facts |= {f"lists_{name}": len(centre), f"probes_{name}": probes, f"recall_{name}": recall}
        found = find(centre, probes)
        release()
        links = found if links is None else links.unionByName(found)
    release(index)
    log.info("search: %s", facts)
    if links is None:
        return membership.select("product_id", F.col("class").alias("group")), facts
    grouped = membership.join(components(links).withColumnRenamed("node", "class"), "class", "left").select("product_id", F.coalesce("component", "class").alias("group"))
    return grouped, facts


def _grouped(spark, sf_dir: str) -> tuple[DataFrame, dict]:
    records = read_table(spark, sf_dir, "device_records")
    units = {r[0]: r[1] for r in read_table(spark, sf_dir, "attribute_refs").where(F.col("common_unit").isNotNull()).select("attribute", "common_unit").collect()}
    return group_listings(records, units)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """product_id_a, product_id_b (a < b): all pairs of different products' ids that are one product."""
    groups = cut(_grouped(spark, sf_dir)[0])
    size = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    several = groups.join(size, "group", "left_semi")
    a, b = several.select("group", F.col("product_id").alias("product_id_a")), several.select("group", F.col("product_id").alias("product_id_b"))
    return a.join(b, "group").where("product_id_a < product_id_b").select("product_id_a", "product_id_b")


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """product_id, group_id (the least product_id of its group), group_size of every product."""
    groups = _grouped(spark, sf_dir)[0]
    within = Window.partitionBy("group")
    return groups.select("product_id", F.min("product_id").over(within).alias("group_id"), F.count("*").over(within).alias("group_size"))
