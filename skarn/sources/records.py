"""Readers and writers of the catalogue's files: fetch log and bodies, robots, sitemaps, JSON lines, CSV, recipes."""

from __future__ import annotations

import urllib.robotparser
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.identity import latest
from skarn.session import ship_package

# Places where a sitemap may lie if robots.txt names none.
SITEMAP_PLACES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz", "/wp-sitemap.xml", "/sitemap/sitemap-index.xml"]
# Marks of shop and content systems in a page's markup.
PLATFORMS = {
    "typo3": ["/typo3/", "typo3temp", "/_assets/"],
    "wordpress": ["/wp-content/", "/wp-includes/"],
    "shopify": ["cdn.shopify.com", "/collections/"],
    "drupal": ["/sites/default/files/", "drupal.js"],
    "aem": ["/etc.clientlibs/", "/content/dam/"],
}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines and fields beyond the schema are skipped, missing ones are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a byte-order mark or none; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV files with a header in the given column order; nulls are empty; extra columns are left out."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_fetches(log: DataFrame) -> DataFrame:
    """The last record of each URL in an append-only fetch log, by time and then by id."""
    return latest(log, ["url"], [F.col("fetched_at"), F.col("fetch_id")])


def with_bodies(fetches: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds found and the body's columns; a log record whose body is gone stays, with found false."""
    return fetches.join(bodies.select("body_path", "body_id", "n_bytes"), "body_path", "left").withColumn("found", F.col("body_id").isNotNull())


def robots_sitemaps(text: Column) -> Column:
    """Addresses in the Sitemap lines of a robots.txt."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), lambda x: F.trim(F.substring(x, 9, 4096)))


def robots_allow(df: DataFrame, robots: str, url: str, agent: str = "*") -> DataFrame:
    """Adds allowed: whether robots.txt lets the agent fetch the URL; missing or unreadable files allow all."""
    ship_package(df.sparkSession)

    def check(texts: pd.Series, urls: pd.Series) -> pd.Series:
        known: dict[str, urllib.robotparser.RobotFileParser] = {}
        out = []
        for t, u in zip(texts, urls):
            if not t or not u:
                out.append(True)
                continue
            if t not in known:
                known[t] = urllib.robotparser.RobotFileParser()
                known[t].parse(t.splitlines())
            out.append(known[t].can_fetch(agent, u))
        return pd.Series(out, index=texts.index)

    return df.withColumn("allowed", F.pandas_udf(check, "boolean")(robots, url))


def is_sitemap(text: Column) -> Column:
    """Whether a response is a sitemap at all: a mark of one in its first 2,048 characters."""
    head = F.lower(F.substring(text, 1, 2048))
    return F.contains(head, F.lit("<urlset")) | F.contains(head, F.lit("<sitemapindex")) | F.contains(head, F.lit("<loc>"))


def sitemap_entries(text: Column) -> Column:
    """array<struct<loc, lastmod>>; the n-th lastmod belongs to the n-th loc, so one that is missing shifts the rest."""
    tag = lambda name: F.regexp_extract_all(text, F.lit(rf"(?is)<{name}>\s*(.*?)\s*</{name}>"), F.lit(1))
    return F.transform(tag("loc"), lambda x, i: F.struct(F.replace(x, F.lit("&amp;"), F.lit("&")).alias("loc"), F.get(tag("lastmod"), i).alias("lastmod")))


def is_sitemap_index(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("<sitemapindex"))


def platform(body: Column) -> Column:
    """The first system that leaves a mark in the markup; null if none does."""
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(body, F.lit(m)) for m in marks]), F.lit(name)) for name, marks in PLATFORMS.items()])


def first_valid_sitemap(responses: DataFrame) -> DataFrame:
    """site, place of the first probed place (site, place, body) whose response is a sitemap, in the order of SITEMAP_PLACES."""
    order = F.array_position(F.array(*[F.lit(p) for p in SITEMAP_PLACES]), F.col("place"))
    found = responses.where((order > 0) & is_sitemap(F.col("body")))
    return found.groupBy("site").agg(F.min(F.struct(order.alias("o"), F.col("place"))).alias("m")).select("site", "m.place")


def decode_body(df: DataFrame, body: str, content_type: str, into: str = "text") -> DataFrame:
    """Adds the text of binary bodies: by the header's charset, the page's own, UTF-8, Windows-1252, UTF-8 with replacements."""
    ship_package(df.sparkSession)

    def decode(bodies: pd.Series, types: pd.Series) -> pd.Series:
        import re

        out = []
        for b, t in zip(bodies, types):
            if b is None:
                out.append(None)
                continue
            b = bytes(b)
            named = re.search(r"charset=[\"']?([\w-]+)", t or "", re.I)
            own = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", b[:4096], re.I)
            for name in (named and named[1], own and own[1].decode("ascii", "ignore"), "utf-8", "cp1252"):
                if name:
                    try:
                        out.append(b.decode(name))
                        break
                    except (LookupError, UnicodeDecodeError):
                        continue
            else:
                out.append(b.decode("utf-8", "replace"))
        return pd.Series(out, index=bodies.index)

    return df.withColumn(into, F.pandas_udf(decode, "string")(body, content_type))


def load_recipes(folders: list[str], domain: str) -> dict:
    """The YAML recipe of a domain: the first folder that has one wins (the user's before the bundled)."""
    import yaml

    for folder in folders:
        path = Path(folder, f"{domain}.yaml")
        if path.exists():
            return yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    return {}


def save_recipe(folder: str, domain: str, recipe: dict) -> None:
    import yaml

    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{domain}.yaml").write_text(yaml.safe_dump(recipe, allow_unicode=True, sort_keys=False), encoding="utf-8")
