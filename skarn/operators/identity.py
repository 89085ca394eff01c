"""Variants of one device and one device on several pages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import attribute_words, group_name, variant_words
from skarn.session import ship_package

# Attributes whose difference alone makes no other device, as parts of their names.
COSMETIC = [
    "rated voltage", "nominal voltage", "supply voltage", "mains voltage", "voltage", "power frequency", "mains frequency", "frequency hz", "phase nominal voltage", "plug", "power cord", "power cable",
    "unit fuse", "fuse", "nominal power", "power consumption", "energy consumption", "connected load", "rated current", "current consumption", "sound pressure level",
    "article number", "order number", "catalog number", "catalogue number", "part number", "sku", "designation", "model code", "region", "market", "country", "certification", "approval", "ul listing",
    "colour", "color", "packaging", "shipping weight", "packing",
    "software version", "firmware", "bundled software", "included software", "software package", "licence", "license", "warranty", "service contract", "documentation language", "manual language", "price", "list price", "delivery time", "availability",
]
# Attributes that matter although their names hold such a part.
FUNCTIONAL = ["operating voltage range", "output voltage"]


def is_cosmetic(attribute: Column) -> Column:
    words = attribute_words(attribute)
    holds = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(words, p))
    return (words == "") | (~holds(FUNCTIONAL) & holds(COSMETIC))


def differing(a: Column, b: Column) -> Column:
    """Sorted keys whose trimmed values differ between two maps; a missing value is blank."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    text = lambda m, k: F.trim(F.coalesce(F.try_element_at(m, k), F.lit("")))
    return F.array_sort(F.filter(keys, lambda k: text(a, k) != text(b, k)))


def group_variants(records: DataFrame, table: str, order: str, name: str, specs: str) -> DataFrame:
    """Variants of each table (order, name, specs map) as devices: table, group, name, variants, specs, differs, reason.

    A variant joins the earliest group whose first member has an equal hardware name and differs from it only in
    cosmetic attributes. Since equal names are needed, groups form inside (table, hardware name), where the fold over an
    ordered array runs in the JVM. A table has few variants; very long ones are folded in one array.
    """
    rows = records.select(F.col(table).alias("t"), F.col(order).alias("o"), F.col(name).alias("n"), F.coalesce(F.col(specs), F.create_map().cast("map<string,string>")).alias("s"), variant_words(F.col(name)).alias("key"))
    members = rows.groupBy("t", "key").agg(F.array_sort(F.collect_list(F.struct("o", "n", F.map_entries("s").alias("e")))).alias("m"))
    m_type, g_type = "struct<o:bigint,n:string,e:array<struct<key:string,value:string>>>", "array<struct<head:array<struct<key:string,value:string>>,m:array<{}>,differs:array<string>>>"
    g_type = g_type.format(m_type)

    def place(groups: Column, x: Column) -> Column:
        compared = F.transform(groups, lambda g: differing(F.map_from_entries(g["head"]), F.map_from_entries(x["e"])))
        fits = F.transform(compared, lambda d: F.forall(d, is_cosmetic))
        at = F.array_position(fits, True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(g["head"].alias("head"), F.concat(g["m"], F.array(x)).alias("m"), F.array_union(g["differs"], F.get(compared, i)).alias("differs"))).otherwise(g))
        opened = F.concat(groups, F.array(F.struct(x["e"].alias("head"), F.array(x).alias("m"), F.array().cast("array<string>").alias("differs"))))
        return F.when(at > 0, joined).otherwise(opened).cast(g_type)

    typed = members.select("t", F.transform("m", lambda x: F.struct(x["o"].cast("bigint").alias("o"), x["n"].alias("n"), x["e"].alias("e"))).alias("m"))
    groups = typed.select("t", F.explode(F.aggregate("m", F.array().cast(g_type), place)).alias("g"))
    variants = F.transform("g.m", lambda x: x["n"])
    first = F.get("g.m", F.lit(0))["o"]
    return groups.select(
        F.col("t").alias(table), first.alias("first_ord"), group_name(variants).alias("name"), variants.alias("variants"),
        F.map_from_entries(F.filter("g.head", lambda e: ~F.array_contains(F.col("g.differs"), e["key"]))).alias("specs"), F.array_sort("g.differs").alias("differs"),
        F.when(F.size("g.m") == 1, "single variant").when(F.size("g.differs") == 0, "identical specifications").otherwise(F.concat(F.lit("differs only in non-functional attributes: "), F.array_join(F.array_sort("g.differs"), ", "))).alias("reason"),
    )


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[®™©]", ""), "[^a-z0-9]+", "")


def merge_pages(records: DataFrame) -> DataFrame:
    """One row per device listed on several pages: record_id, name, url, specs (JSON), merged (record ids), pages.

    records: record_id, name, url, specs map. Records whose names are equal but for case, spaces and marks are merged into the
    one with most specifications, in that order, if no shared value disagrees and either the name has a digit or three
    values agree; at one URL all must agree. Filling gaps goes on as it merges, so the fold is ordered. Exact copies of
    a record are one before folding; their record ids are merged into it. Each name is folded as one sorted stream,
    however many pages share it; a task holds a batch of rows and the row that it merges into. Rows with an empty name
    stay alone.
    """
    ship_package(records.sparkSession)
    rows = records.select("record_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("url"), F.to_json(F.coalesce("specs", F.create_map().cast("map<string,string>"))).alias("specs"))
    rows = rows.groupBy("name", "url", "specs").agg(F.min("record_id").alias("record_id"), F.array_sort(F.collect_set("record_id")).alias("ids"))
    rows = rows.withColumn("copies", F.array_join(F.filter("ids", lambda x: x != F.col("record_id")), ";"))
    rows = rows.withColumn("key", F.when(name_key(F.col("name")) == "", F.concat(F.lit("#"), F.col("record_id"))).otherwise(name_key(F.col("name"))))
    rows = rows.withColumn("n", F.size(F.map_keys(F.from_json("specs", "map<string,string>"))))
    placed = rows.select("key", "n", "record_id", "name", "url", "specs", "copies").repartition("key").sortWithinPartitions("key", F.desc("n"), "record_id")
    return placed.mapInPandas(_fold_all, "record_id bigint, name string, url string, specs string, merged string, pages int")


def _agree(a: dict, b: dict, same_url: bool, name: str) -> bool:
    shared = a.keys() & b.keys()
    if any(a[k] != b[k] for k in shared):
        return False
    return a == b if same_url else bool(re.search(r"\d", name)) or len(shared) >= 3


def _fold_all(batches):
    """The folds of all names of a partition, one after the other; rows come sorted by name."""
    keep, group = None, None
    for rows in batches:
        out: list[list] = []
        for r in rows.itertuples(index=False):
            specs, copies = json.loads(r.specs), r.copies.split(";") if r.copies else []
            if r.key != group:
                if keep:
                    out.append(keep)
                group, keep = r.key, [r.record_id, r.name, r.url, specs, copies, 1]
            elif _agree(keep[3], specs, keep[2] == r.url, keep[1]):
                keep[3] = {**specs, **keep[3]}
                keep[4] += [str(r.record_id), *copies]
                keep[5] += r.url != keep[2]
            else:
                out.append([r.record_id, r.name, r.url, specs, copies, 1])
        yield _folded(out)
    if keep:
        yield _folded([keep])


def _folded(out: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(a, b, c, json.dumps(d, sort_keys=True, ensure_ascii=False), ";".join(e), f) for a, b, c, d, e, f in out], columns=["record_id", "name", "url", "specs", "merged", "pages"])


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row per key of an append-only log; order must be total. Rows are combined before the shuffle, so a hot key is no hot task."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__last"))
    return last.select(*[F.col(f"__last.{c}").alias(c) for c in df.columns])


def fill_gaps(devices: DataFrame, sheets: DataFrame, url: str, specs: str) -> DataFrame:
    """Fills attributes that a device lacks from the sheet of its URL (url, sheet map), only where one device has that URL."""
    count = F.count("*").over(Window.partitionBy(url))
    both = devices.withColumn("__n", count).join(sheets.select(F.col("url").alias(url), "sheet"), url, "left")
    missing = F.map_filter("sheet", lambda k, v: ~F.array_contains(F.map_keys(F.col(specs)), k))
    return both.withColumn(specs, F.when((F.col("__n") == 1) & F.col("sheet").isNotNull(), F.map_concat(specs, missing)).otherwise(F.col(specs))).drop("__n", "sheet")
