"""A site's URL inventory: prefix rollups, leaves, candidate selection, query variants, inferred rules, link frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import urls as U
from skarn.session import cut


def prefix_tree(df: DataFrame, url: str, order: str, max_depth: int = 3, samples: int = 3) -> DataFrame:
    """prefix, depth, count, samples: URLs under each path prefix, and the first few of them by order.

    A rollup over path segments: each URL gives one row per prefix, counts are combined before the shuffle, and samples
    are kept by bounded minima instead of collected groups.
    """
    parts = df.select(F.col(url).alias("url"), F.col(order).alias("ord"), U.segments(F.col(url)).alias("seg")).where(F.size("seg") > 0)
    each = parts.select("url", "ord", "seg", F.explode(F.sequence(F.lit(1), F.least(F.size("seg"), F.lit(max_depth)))).alias("depth"))
    each = each.select(F.concat(F.lit("/"), F.array_join(F.slice("seg", F.lit(1), F.col("depth")), "/")).alias("prefix"), "depth", "url", "ord")
    counts = each.groupBy("prefix", "depth").agg(F.count("*").alias("count"))
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("ord", "url"))).where(F.col("rank") <= samples)
    first = first.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("samples"))
    return counts.join(first, "prefix")


def depth_histogram(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """depth, count of the URLs whose path starts with prefix."""
    kept = df.where(U.path(F.col(url)).startswith(prefix)) if prefix else df
    return kept.groupBy(U.depth(F.col(url)).alias("depth")).agg(F.count("*").alias("count"))


def depths_by_root(df: DataFrame, url: str) -> DataFrame:
    """root (the first path segment, empty if there is none), depth, count: the depth histogram of every part of a site."""
    root = F.coalesce(F.get(U.segments(F.col(url)), F.lit(0)), F.lit(""))
    return df.groupBy(root.alias("root"), U.depth(F.col(url)).alias("depth")).agg(F.count("*").alias("count"))


def _slashed(url: Column) -> Column:
    path = U.path(url)
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def inner_paths(df: DataFrame, url: str) -> DataFrame:
    """path of every proper ancestor (with a closing slash) of some URL's path; hosts share one space of paths."""
    own = df.select(_slashed(F.col(url)).alias("p")).distinct()
    names = F.split(F.regexp_replace("p", "^/|/$", ""), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), n), "/"), F.lit("/"))))
    return own.select("p", F.explode(up).alias("path")).where(F.col("path") != F.col("p")).select("path").distinct()


def leaves(df: DataFrame, url: str) -> DataFrame:
    """The rows whose path no other path extends: an anti-join with all ancestors, without a global sort."""
    return df.withColumn("__path", _slashed(F.col(url))).join(inner_paths(df, url).withColumnRenamed("path", "__path"), "__path", "left_anti").drop("__path")


def select_candidates(df: DataFrame, url: str, include: list[str] | None = None, exclude: list[str] | None = None, depths: list[int] | None = None, leaf_only: bool = False, slug_suffix: str | None = None) -> DataFrame:
    """Rows by shell patterns on the path, depth, being a leaf of the whole site, and the slug's ending."""
    path = U.path(F.col(url))
    any_of = lambda patterns: reduce(lambda a, b: a | b, [path.rlike(U.glob(p)) for p in patterns], F.lit(False))
    kept = leaves(df, url) if leaf_only else df
    kept = kept.where(any_of(include or ["**"]) & ~any_of(exclude or []))
    if depths:
        kept = kept.where(U.depth(F.col(url)).isin(*depths))
    return kept.where(F.coalesce(U.slug(F.col(url)), F.lit("")).endswith(slug_suffix)) if slug_suffix is not None else kept


def prefix_matches(df: DataFrame, url: str, prefixes: list[str], base_host: Column) -> Column:
    """Whether the URL starts with any prefix: "/path" on the base host, "host/path" on that host; a star at the end is dropped."""
    path, host = U.path(F.col(url)), U.part(F.col(url), 2)
    tests = []
    for p in prefixes:
        name, _, rest = p.partition("/")
        tests.append((host == base_host) & path.startswith(p.rstrip("*")) if p.startswith("/") else (host == name) & path.startswith("/" + rest.rstrip("*")))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def collapse_query_variants(df: DataFrame, url: str, order: str) -> DataFrame:
    """page, chosen, others: one row per URL without query and fragment. Chosen is the first member without a query, else
    the least; others are the rest, sorted. A page's variants are one group."""
    page = F.concat(F.regexp_replace(F.regexp_replace(F.col(url), "#.*$", ""), r"\?.*$", ""))
    rows = df.select(page.alias("page"), F.col(url).alias("url"), F.col(order).alias("ord"), (U.part(F.col(url), 4) == "").alias("bare"))
    grouped = rows.groupBy("page").agg(F.min(F.when(F.col("bare"), F.struct("ord", "url")))["url"].alias("b"), F.min("url").alias("least"), F.collect_list("url").alias("all"))
    chosen = F.coalesce("b", "least")
    return grouped.select("page", chosen.alias("chosen"), F.array_sort(F.filter("all", lambda u: u != chosen)).alias("others"))


def infer_rules(df: DataFrame, url: str, order: str) -> DataFrame:
    """root, hits, known, family_depth: the catalogue's path prefix and the depth with most pages below it.

    The prefix is a locale, if any, and the next segment; known catalogue segments win over the largest other branch;
    ties go to the prefix seen first.
    """
    seg = F.transform(U.segments(F.col(url)), lambda s: F.lower(s))
    lead = F.when(F.coalesce(F.get(seg, F.lit(0)).isin(*U.LOCALES), F.lit(False)), 1).otherwise(0)
    rows = df.select(seg.alias("seg"), lead.alias("lead"), F.col(order).alias("ord")).where(F.size("seg") > F.col("lead"))
    body = F.get("seg", F.col("lead"))
    rows = rows.select(F.concat(F.lit("/"), F.array_join(F.slice("seg", F.lit(1), F.col("lead") + 1), "/")).alias("root"), body.isin(*U.CATALOGUE_SEGMENTS).alias("known"), body.isin(*U.OTHER_SEGMENTS).alias("other"), F.get("seg", F.lit(0)).isin(*U.LOCALES).alias("local"), "ord")
    roots = rows.where(F.col("known") | ~F.col("other")).groupBy("root", "known", "local").agg(F.count("*").alias("hits"), F.min("ord").alias("first"))
    best = roots.orderBy(F.desc("known"), F.desc("hits"), "first").limit(1)
    below = df.select(U.path(F.col(url)).alias("path"), U.depth(F.col(url)).alias("depth"), F.col(order).alias("ord"))
    depths = below.join(F.broadcast(best), F.col("path").startswith(F.concat("root", F.lit("/")))).groupBy("root", "known", "local", "hits", "depth").agg(F.count("*").alias("n"), F.min("depth").alias("d"))
    deep = F.col("depth") >= F.when(F.col("local"), 3).otherwise(2)
    return depths.groupBy("root", "known", "hits").agg(F.coalesce(F.max(F.when(deep, F.struct(F.col("n"), -F.col("depth")))), F.max(F.struct(F.col("n"), -F.col("depth")))).alias("m")).select("root", "hits", "known", (-F.col("m")[F.lit("col2")]).alias("family_depth"))


def branch_groups(df: DataFrame, url: str, order: str, samples: int = 3) -> DataFrame:
    """branch, count, slugs: candidates by the path above them, with the first slugs."""
    seg = U.segments(F.col(url))
    rows = df.select(F.concat(F.lit("/"), F.array_join(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), "/")).alias("branch"), U.slug_words(F.col(url)).alias("slug"), F.col(order).alias("ord"))
    counts = rows.groupBy("branch").agg(F.count("*").alias("count"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("branch").orderBy("ord", "slug"))).where(F.col("rank") <= samples)
    return counts.join(first.groupBy("branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda s: s["slug"]).alias("slugs")), "branch")


def crawl(links: DataFrame, seeds: DataFrame, rejected: DataFrame | None = None, max_depth: int = 2) -> DataFrame:
    """url, parent, depth of what is reached from seeds over links (parent, url): breadth first, each URL once.

    links are filtered before they are followed; rejected URLs are never taken. Every round joins only the newest rows
    with the links, drops what was seen by an anti-join and is written to the checkpoint folder; the least parent wins.
    """
    links = links.where(~U.is_editorial(F.col("url")) & ~U.is_junk(F.col("url")) & ~U.is_asset(F.col("url")))
    if rejected is not None:
        links = links.join(rejected.select("url"), "url", "left_anti")
    newest = cut(seeds.select("url").distinct().select("url", F.lit("").alias("parent"), F.lit(0).alias("depth")))
    seen = newest
    for d in range(1, max_depth + 1):
        step = links.join(newest.select(F.col("url").alias("parent")), "parent").groupBy("url").agg(F.min("parent").alias("parent"))
        newest = cut(step.join(seen.select("url"), "url", "left_anti").select("url", "parent", F.lit(d).alias("depth")))
        if newest.limit(1).count() == 0:
            break
        seen = seen.unionByName(newest)
    return seen
