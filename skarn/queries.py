"""Queries over the given tables, one per group of core operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.functions import urls as U
from skarn.functions.specvalue import spec_value
from skarn.operators import grids, identity, inventory, logs
from skarn.operators.signals import digest, page_signals
from skarn.plans import extract
from skarn.session import read_table, spread
from skarn.sources import records as R
from skarn.sources.html import with_page

_PARTS = U.PARTS.replace("'", "''")
#: SQL for the path of a URL column, its segments, and a path with a closing slash.
PATH = "regexp_extract({u}, '" + _PARTS + "', 3)"
SEGMENTS = "list_filter(string_split(" + PATH + ", '/'), lambda s: s <> '')"
SLASHED = "CASE WHEN " + PATH + " LIKE '%/' THEN " + PATH + " ELSE " + PATH + " || '/' END"
ALTERNATIVES = "|".join


def _p(name: str, u: str = "url") -> str:
    return {"path": PATH, "seg": SEGMENTS, "slashed": SLASHED}[name].replace("{u}", u)


REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


@query(
    f"""SELECT fetch_id, len({_p('seg')}) AS depth, coalesce({_p('seg')}[-1], '') AS slug, substr(regexp_replace(coalesce({_p('seg')}[-1], ''), '[-_]', ' ', 'g'), 1, 80) AS words,
    CASE WHEN len({_p('seg')}) >= 2 THEN {_p('seg')}[-2] ELSE '' END AS category,
    regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^www\\.', '') || regexp_replace({_p('path')}, '/+$', '') AS page_key
    FROM fetch_index"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Depth, slug, slug words, category segment and identity of every fetched URL."""
    u = F.col("url")
    return read_table(spark, d, "fetch_index").select("fetch_id", U.depth(u).alias("depth"), F.coalesce(U.slug(u), F.lit("")).alias("slug"), U.slug_words(u).alias("words"), U.category(u).alias("category"), U.page_key(u).alias("page_key"))


@query(
    f"""WITH q AS (SELECT fetch_id, final_url, regexp_replace(regexp_replace(final_url, '#.*$', ''), '\\?.*$', '') AS base, array_to_string(list_filter(string_split(regexp_extract(final_url, '{_PARTS}', 4), '&'),
    lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '{U.TRACKING}')), '&') AS kept, list_filter(string_split(lower(regexp_extract(final_url, '{_PARTS}', 2)), '.'), lambda x: x <> '') AS labels FROM fetch_index)
    SELECT fetch_id, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical,
    CASE WHEN len(labels) >= 3 AND labels[-2] IN ('co','com','net','org','ac','gov') THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM q"""
)
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Final URLs without fragments and tracking parameters, and their registrable domains."""
    u = F.col("final_url")
    return read_table(spark, d, "fetch_index").select("fetch_id", U.canonical(u).alias("canonical"), U.registrable_domain(U.part(u, 2)).alias("domain"))


@query(
    f"""SELECT fetch_id, regexp_matches({_p('path', 'final_url')}, '{U.EDITORIAL}') AS editorial, regexp_matches(final_url, '{U.JUNK}') AS junk, regexp_matches(final_url, '{U.ASSET}') AS asset,
    regexp_matches(regexp_extract(final_url, '{_PARTS}', 4), '{U.PAGE_QUERY}') OR regexp_matches({_p('path', 'final_url')}, '{U.PAGE_PATH}') AS paged,
    CASE WHEN regexp_matches(lower({_p('path', 'final_url')}), '{ALTERNATIVES(U.CATALOGUE_HINTS)}') THEN 0 WHEN regexp_matches(lower({_p('path', 'final_url')}), '{ALTERNATIVES(U.EDITORIAL_HINTS)}') THEN 2 ELSE 1 END AS priority
    FROM fetch_index"""
)
def url_filters(spark: SparkSession, d: str) -> DataFrame:
    """Editorial, junk, asset and pagination tests and the crawl priority of every fetched URL."""
    u = F.col("final_url")
    return read_table(spark, d, "fetch_index").select("fetch_id", U.is_editorial(u).alias("editorial"), U.is_junk(u).alias("junk"), U.is_asset(u).alias("asset"), U.is_pagination(u).alias("paged"), U.crawl_priority(u).alias("priority"))


@query(
    f"""WITH x AS (SELECT fetch_id, url, {_p('seg')} AS seg FROM fetch_index), e AS (SELECT fetch_id, url, unnest(range(1, least(len(seg), 3) + 1)) AS depth, seg FROM x WHERE len(seg) > 0),
    f AS (SELECT fetch_id, url, depth, '/' || array_to_string(seg[1:depth], '/') AS prefix FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY fetch_id, url) AS rk FROM f)
    SELECT prefix, CAST(depth AS INT) AS depth, count(*) AS count, string_agg(CASE WHEN rk <= 3 THEN url END, ' ' ORDER BY rk) AS samples FROM g GROUP BY prefix, depth"""
)
def url_prefix_tree(spark: SparkSession, d: str) -> DataFrame:
    """URLs per path prefix to depth three, with the first three of each."""
    out = inventory.prefix_tree(read_table(spark, d, "fetch_index").select("fetch_id", "url"), "url", "fetch_id")
    return out.select("prefix", "depth", "count", F.array_join("samples", " ").alias("samples"))


@query(f"SELECT coalesce({_p('seg')}[1], '') AS root, CAST(len({_p('seg')}) AS INT) AS depth, count(*) AS count FROM fetch_index GROUP BY 1, 2")
def url_depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Depths of all fetched URLs by the first segment of their path."""
    return inventory.depths_by_root(read_table(spark, d, "fetch_index"), "url")


#: SQL of the derived URL set: pages and the category pages above them.
_SITE = f"""site AS (SELECT DISTINCT url FROM fetch_index UNION SELECT DISTINCT regexp_replace(url, '/[^/]*/?$', '') FROM fetch_index WHERE len({_p('seg')}) >= 2)"""
_LEAVES = f"""paths AS (SELECT DISTINCT {_p('slashed')} AS p FROM site), ahead AS (SELECT p, lead(p) OVER (ORDER BY p) AS nx FROM paths), leaf AS (SELECT p FROM ahead WHERE nx IS NULL OR NOT starts_with(nx, p))"""


def _site(spark: SparkSession, d: str) -> DataFrame:
    urls = read_table(spark, d, "fetch_index").select("url")
    above = urls.where(U.depth(F.col("url")) >= 2).select(F.regexp_replace("url", "/[^/]*/?$", "").alias("url"))
    return urls.union(above).distinct()


@query(f"WITH {_SITE}, {_LEAVES} SELECT url FROM site WHERE {_p('slashed')} IN (SELECT p FROM leaf)")
def url_leaves(spark: SparkSession, d: str) -> DataFrame:
    """URLs that no other URL extends, of pages and their category pages."""
    return inventory.leaves(_site(spark, d), "url")


@query(f"WITH {_SITE}, {_LEAVES} SELECT CAST(len({_p('seg')}) AS INT) AS depth, count(*) AS count FROM site WHERE {_p('slashed')} IN (SELECT p FROM leaf) GROUP BY 1")
def url_leaf_depths(spark: SparkSession, d: str) -> DataFrame:
    return inventory.depth_histogram(inventory.leaves(_site(spark, d), "url"), "url")


@query(f"WITH {_SITE}, {_LEAVES} SELECT url FROM site WHERE {_p('slashed')} IN (SELECT p FROM leaf) AND ({_p('path')} GLOB '/en/*' OR {_p('path')} GLOB '/de/products/*') AND NOT {_p('path')} GLOB '*/shop/*' AND len({_p('seg')}) IN (3, 4)")
def url_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Leaves under two patterns, without a third, at two depths."""
    return inventory.select_candidates(_site(spark, d), "url", ["/en/*", "/de/products/*"], ["*/shop/*"], [3, 4], leaf_only=True)


@query(
    f"""WITH q AS (SELECT fetch_id, final_url AS url, regexp_replace(regexp_replace(final_url, '#.*$', ''), '\\?.*$', '') AS page, regexp_extract(final_url, '{_PARTS}', 4) = '' AS bare FROM fetch_index),
    g AS (SELECT page, coalesce(arg_min(url, (fetch_id, url)) FILTER (bare), min(url)) AS chosen, list(url) AS urls FROM q GROUP BY page)
    SELECT page, chosen, array_to_string(list_sort(list_filter(urls, lambda u: u <> chosen)), ' ') AS others FROM g"""
)
def url_query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Final URLs that differ only by query or fragment, under one page."""
    out = inventory.collapse_query_variants(read_table(spark, d, "fetch_index").select("fetch_id", "final_url"), "final_url", "fetch_id")
    return out.select("page", "chosen", F.array_join("others", " ").alias("others"))


@query(
    f"""WITH s AS (SELECT fetch_id, list_transform({_p('seg')}, lambda x: lower(x)) AS seg FROM fetch_index), l AS (SELECT *, CASE WHEN seg[1] IN ({', '.join(repr(x) for x in U.LOCALES)}) THEN 1 ELSE 0 END AS lead FROM s),
    r AS (SELECT fetch_id, lead, '/' || array_to_string(seg[1:lead + 1], '/') AS root, seg[lead + 1] AS b FROM l WHERE len(seg) > lead),
    c AS (SELECT root, b IN ({', '.join(repr(x) for x in U.CATALOGUE_SEGMENTS)}) AS known, lead, count(*) AS hits, min(fetch_id) AS f FROM r WHERE b IN ({', '.join(repr(x) for x in U.CATALOGUE_SEGMENTS)}) OR b NOT IN ({', '.join(repr(x) for x in U.OTHER_SEGMENTS)}) GROUP BY ALL),
    best AS (SELECT * FROM c ORDER BY known DESC, hits DESC, f LIMIT 1),
    d AS (SELECT root, known, hits, lead, len({_p('seg')}) AS depth, count(*) AS n FROM fetch_index, best WHERE starts_with({_p('path')}, root || '/') GROUP BY ALL)
    SELECT root, hits, known, CAST(coalesce(arg_max(depth, n * 1000 - depth) FILTER (depth >= lead + 2), arg_max(depth, n * 1000 - depth)) AS INT) AS family_depth FROM d GROUP BY root, hits, known"""
)
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's path prefix and modal depth, inferred from all URLs."""
    return inventory.infer_rules(read_table(spark, d, "fetch_index").select("fetch_id", "url"), "url", "fetch_id").select("root", "hits", "known", F.col("family_depth").cast("int").alias("family_depth"))


@query(
    f"""WITH x AS (SELECT fetch_id, {_p('seg')} AS seg FROM fetch_index), y AS (SELECT fetch_id, '/' || array_to_string(seg[1:greatest(len(seg) - 1, 0)], '/') AS branch, substr(regexp_replace(coalesce(seg[-1], ''), '[-_]', ' ', 'g'), 1, 80) AS slug FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY fetch_id, slug) AS rk FROM y) SELECT branch, count(*) AS count, string_agg(CASE WHEN rk <= 3 THEN slug END, '|' ORDER BY rk) AS slugs FROM z GROUP BY branch"""
)
def url_branches(spark: SparkSession, d: str) -> DataFrame:
    """Candidates grouped by the path above them, with three slugs each."""
    out = inventory.branch_groups(read_table(spark, d, "fetch_index").select("fetch_id", "url"), "url", "fetch_id")
    return out.select("branch", "count", F.array_join("slugs", "|").alias("slugs"))


@query(
    f"""WITH RECURSIVE l AS (SELECT DISTINCT regexp_replace(url, '/[^/]*/?$', '') AS parent, url FROM (SELECT url FROM fetch_index UNION SELECT regexp_replace(url, '/[^/]*/?$', '') FROM fetch_index)
    WHERE len({_p('seg')}) >= 1 AND NOT regexp_matches({_p('path')}, '{U.EDITORIAL}') AND NOT regexp_matches(url, '{U.JUNK}') AND NOT regexp_matches(url, '{U.ASSET}')),
    t AS (SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*/[^/]*/[^/]*') AS url, 0 AS depth FROM fetch_index UNION SELECT l.url, depth + 1 FROM t JOIN l ON l.parent = t.url WHERE depth < 2)
    SELECT url, CAST(min(depth) AS INT) AS depth FROM t GROUP BY url"""
)
def url_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What is reached from the catalogue roots over links from a path to those below it, in two rounds."""
    urls = read_table(spark, d, "fetch_index").select("url")
    up = F.regexp_replace("url", "/[^/]*/?$", "")
    every = urls.union(urls.select(up.alias("url"))).distinct().where(U.depth(F.col("url")) >= 1)
    seeds = urls.select(F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*/[^/]*", 0).alias("url"))
    return inventory.crawl(every.select(up.alias("parent"), "url"), seeds).select("url", "depth")


@query("SELECT * EXCLUDE (rn) FROM (SELECT url, fetch_id, status, source, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) AS rn FROM fetch_index) WHERE rn = 1")
def latest_fetches(spark: SparkSession, d: str) -> DataFrame:
    """The last log record of each URL."""
    return R.latest_fetches(read_table(spark, d, "fetch_index")).select("url", "fetch_id", "status", "source")


@query("SELECT f.vendor, count(*) AS fetches, count(b.body_id) AS bodies, count(*) - count(b.body_id) AS missing, count(DISTINCT f.url) AS urls, sum(b.n_bytes)::BIGINT AS n_bytes FROM fetch_index f LEFT JOIN page_bodies b ON f.body_path = b.body_path GROUP BY f.vendor")
def fetch_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Fetches joined with their stored bodies, misses counted, per site."""
    joined = R.with_bodies(read_table(spark, d, "fetch_index"), read_table(spark, d, "page_bodies"))
    return joined.groupBy("vendor").agg(F.count("*").alias("fetches"), F.count("body_id").alias("bodies"), F.count_if(~F.col("found")).alias("missing"), F.countDistinct("url").alias("urls"), F.sum("n_bytes").alias("n_bytes"))


@query("SELECT spec_id, regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, trim(regexp_replace(lower(trim(label)), '[^a-z0-9 ]+', ' ', 'g')) AS words FROM spec_values")
def attribute_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stable keys and plain words of attribute labels."""
    return read_table(spark, d, "spec_values").select("spec_id", T.attribute_key(F.col("label")).alias("key"), T.attribute_words(F.col("label")).alias("words"))


_CODE = r"\b[A-Z0-9]{2,}[-./][A-Z0-9]{2,}[-./][A-Z0-9]{1,}\b"


@query(
    rf"""WITH c AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?i){_CODE}', 0), lambda x: regexp_matches(x, '^[A-Za-z0-9]*[0-9]') AND NOT regexp_matches(x, '{T.DATE_START}')) AS l FROM documents)
    SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(l))[1:20], ' '), '') AS codes FROM c"""
)
def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Order codes in whole texts, without dates, the first twenty of each."""
    return read_table(spark, d, "documents").select("doc_id", F.array_join(T.order_numbers(F.col("text")), " ").alias("codes"))


@query(
    "SELECT doc_id, " + " || ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}', 'i') THEN '{n};' ELSE '' END" for n, p in sorted(T.INTERFACES.items())) + " AS interfaces FROM documents"
)
def interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces that whole texts mention."""
    found = T.interfaces(F.coalesce(F.col("text"), F.lit("")))
    return read_table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "").alias("interfaces"))


@query("SELECT doc_id, greatest(1, CAST(round_even(length(text) / 3.5, 0) AS INT)) AS tokens, len(regexp_extract_all(text, '\\S+')) AS words FROM documents WHERE text IS NOT NULL")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens and words of whole texts."""
    return read_table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.count_words(F.col("text")).alias("words"))


@query(
    r"""WITH a AS (SELECT listing_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(name, ''), '\s*[▶►▸›»→➔]+\s*$', ''), '\s+([®™©])', '\1', 'g'), '\s+TM\b', '™', 'g')) AS t FROM device_records),
    b AS (SELECT listing_id, trim(regexp_replace(t, '[\s\x{00a0}]+', ' ', 'g')) AS label FROM a), c AS (SELECT listing_id, label, regexp_replace(label, '\s*[A-Z]{0,4}\d[\dA-Za-z]*(?:-[\dA-Za-z]+){2,}\s*$', '') AS v FROM b),
    e AS (SELECT listing_id, label, v, CASE WHEN contains(v, ' | ') AND length(trim(split_part(v, ' | ', 1))) >= 3 THEN trim(split_part(v, ' | ', 1)) WHEN contains(v, ' - ') AND length(trim(split_part(v, ' - ', 1))) >= 3 THEN trim(split_part(v, ' - ', 1))
    WHEN contains(v, ' – ') AND length(trim(split_part(v, ' – ', 1))) >= 3 THEN trim(split_part(v, ' – ', 1)) WHEN contains(v, ' — ') AND length(trim(split_part(v, ' — ', 1))) >= 3 THEN trim(split_part(v, ' — ', 1)) ELSE v END AS h FROM c)
    SELECT listing_id, label, regexp_replace(h, '^[ –—:,-]+|[ –—:,-]+$', '', 'g') AS variant FROM e"""
)
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """Labels without decoration and variant names without marketing."""
    return read_table(spark, d, "device_records").select("listing_id", T.clean_label(F.col("name")).alias("label"), T.clean_variant(F.col("name")).alias("variant"))


@query(
    rf"""WITH v AS (SELECT listing_id, unnest(source_variants) AS v FROM device_records)
    SELECT listing_id, v AS variant, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(v, '{T.LONG_CODE}', ' ', 'g'), '{T.REGIONAL}', ' ', 'g'), '(?i)(\d)(?:ul|ce|csa)\b', '\1 ', 'g')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS hardware FROM v"""
)
def variant_names(spark: SparkSession, d: str) -> DataFrame:
    """What hardware a variant's name denotes, without voltages, approvals and codes."""
    return read_table(spark, d, "device_records").select("listing_id", F.explode("source_variants").alias("variant")).withColumn("hardware", T.variant_words(F.col("variant")))


_NUM = r"[-+]?\d+(?:[.,]\d+)*"
_PN = "CASE WHEN contains({x}, '.') AND contains({x}, ',') THEN CASE WHEN strpos(reverse({x}), ',') < strpos(reverse({x}), '.') THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END WHEN contains({x}, ',') THEN CASE WHEN length(split_part({x}, ',', -1)) = 3 THEN replace({x}, ',', '') ELSE replace({x}, ',', '.') END ELSE {x} END"


def _number_sql(x: str) -> str:
    inner = _PN.replace("{x}", x)
    return f"CASE WHEN regexp_matches({inner}, '^[-+]?[0-9]+(\\.[0-9]+)?$') THEN CAST({inner} AS DOUBLE) END"


@query(
    rf"""WITH t AS (SELECT spec_id, trim(regexp_replace(coalesce(raw, ''), '[\s\x{{00a0}}]+', ' ', 'g')) AS t FROM spec_values),
    w AS (SELECT *, regexp_replace(lower(t), '^[ .]+|[ .]+$', '', 'g') AS word, regexp_extract(t, '(?i)^\s*({_NUM})\s*(?:\.{{2,3}}|-|–|—|to|bis)\s*({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}}?)\s*(?:\(.*\))?\s*$', ['lo', 'hi', 'u']) AS r,
    regexp_extract(t, '^\s*({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}})$', ['n', 'u']) AS s, regexp_extract(t, '(<=|>=|<|>|≤|≥)\s*({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}})', ['c', 'n', 'u']) AS c,
    regexp_matches(t, '^\s*{_NUM}(?:\s*/\s*{_NUM})+\s*[°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}}$') AS is_set, regexp_extract(t, '^\s*({_NUM})', 1) AS s1, regexp_extract(t, '^\s*{_NUM}(?:\s*/\s*{_NUM})+\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}})$', 1) AS setu,
    regexp_extract(t, '(?i)({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}}?)\s*[x×]\s*({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}}?)\s*[x×]\s*({_NUM})\s*([°µμ]?[A-Za-zΩ%°/·.\s]{{0,14}})', ['a', 'ua', 'b', 'ub', 'c', 'uc']) AS dm FROM t),
    n AS (SELECT spec_id, t, word, is_set, setu, {_number_sql('s1')} AS setn, {_number_sql('dm.a')} AS da, {_number_sql('dm.b')} AS db, {_number_sql('dm.c')} AS dc, coalesce(nullif(dm.uc, ''), nullif(dm.ub, ''), dm.ua) AS du, r.u AS ru, s.u AS su, c.c AS cc, c.u AS cu, {_number_sql('r.lo')} AS lo, {_number_sql('r.hi')} AS hi, {_number_sql('s.n')} AS sn, {_number_sql('c.n')} AS cn FROM w),
    k AS (SELECT *, CASE WHEN t = '' THEN 'text' WHEN word IN ('yes','ja','standard','included','available','✓','x') THEN 'boolean' WHEN word IN ('no','nein','none','not available','n/a','na','-','--','—') THEN 'boolean'
    WHEN da IS NOT NULL AND db IS NOT NULL AND dc IS NOT NULL THEN 'dimensions' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'range' WHEN is_set THEN 'number' WHEN sn IS NOT NULL THEN 'number' WHEN cn IS NOT NULL THEN 'comparison' ELSE 'text' END AS kind FROM n)
    SELECT spec_id, kind, CASE kind WHEN 'boolean' THEN CASE WHEN word IN ('yes','ja','standard','included','available','✓','x') THEN 1.0 ELSE 0.0 END WHEN 'number' THEN CASE WHEN is_set THEN setn ELSE sn END WHEN 'comparison' THEN cn END AS value,
    CASE WHEN kind = 'range' THEN lo END AS value_min, CASE WHEN kind = 'range' THEN hi END AS value_max,
    nullif(regexp_replace(regexp_replace(CASE kind WHEN 'dimensions' THEN du WHEN 'range' THEN ru WHEN 'number' THEN CASE WHEN is_set THEN setu ELSE su END WHEN 'comparison' THEN cu END, '^[ .·]+|[ .·]+$', '', 'g'), '\s+', ' ', 'g'), '') AS unit, CASE WHEN kind = 'comparison' THEN cc END AS comparator FROM k"""
)
def spec_values_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every raw specification as a typed value: kind, amounts, unit, comparator."""
    s = read_table(spark, d, "spec_values").select("spec_id", spec_value(F.col("raw")).alias("s"))
    return s.select("spec_id", "s.kind", "s.value", "s.value_min", "s.value_max", "s.unit", "s.comparator")


@query("SELECT listing_id, product_id, manufacturer, name AS device, url AS source_url, e.key AS attribute, trim(regexp_replace(coalesce(e.value, ''), '[\\s\\x{00a0}]+', ' ', 'g')) AS raw FROM device_records, unnest(map_entries(specs)) AS t(e)")
def specs_eav(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and attribute."""
    return extract.eav(read_table(spark, d, "device_records")).select("listing_id", "product_id", "manufacturer", "device", "source_url", "attribute", "raw")


@query(
    "SELECT listing_id, product_id, coalesce(manufacturer, '') AS manufacturer, coalesce(name, '') AS name, coalesce(category, '') AS category, coalesce(url, '') AS url, coalesce(array_to_string(interfaces, '; '), '') AS interfaces, substr(coalesce(description, ''), 1, 300) AS description, coalesce(image_url, '') AS image_url, coalesce(array_to_string(datasheet_urls[1:5], '; '), '') AS datasheet_urls, coalesce(cardinality(specs), 0) AS n_specs FROM device_records"
)
def devices_wide(spark: SparkSession, d: str) -> DataFrame:
    """The deliverable table; the specs' JSON, whose key order is free, stands as their number."""
    w = extract.wide(read_table(spark, d, "device_records"))
    return w.withColumn("n_specs", F.coalesce(F.size(F.from_json("specs", "map<string,string>")), F.lit(0)).cast("bigint")).drop("specs")


@query(
    """WITH m AS (SELECT listing_id, coalesce(category, '') AS category, specs FROM device_records), n AS (SELECT category, greatest(1, CAST(floor(count(*) * 0.5) AS BIGINT)) AS least FROM m GROUP BY category), e AS (SELECT listing_id, category, e.key AS a, e.value AS v FROM m, unnest(map_entries(specs)) AS t(e)),
    c AS (SELECT category, a FROM e JOIN n USING (category) GROUP BY category, a, least HAVING count(*) >= least) SELECT m.listing_id, m.category, string_agg(c.a || '=' || coalesce(e.v, ''), '|' ORDER BY c.a) AS cells FROM m JOIN c ON c.category = m.category LEFT JOIN e ON e.listing_id = m.listing_id AND e.a = c.a GROUP BY m.listing_id, m.category"""
)
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Every category's frequent attributes as columns; here joined again, so that the result's columns are fixed."""
    p = extract.pivot_categories(read_table(spark, d, "device_records"))
    return p.select("listing_id", "category", F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("cells"))


_GRID = """once AS (SELECT table_id, attr_ord, ent_ord, max(attribute) AS attribute, max(entity) AS entity, max(coalesce(value, '')) AS value FROM spec_cells GROUP BY ALL)"""


@query(
    f"""WITH {_GRID}, w AS (SELECT table_id, ent_ord, max(entity) AS entity FROM once GROUP BY ALL), r AS (SELECT table_id, attr_ord, max(attribute) AS attribute FROM once GROUP BY ALL)
    SELECT o.table_id, CAST(o.ent_ord AS INT) AS ent_ord, o.attr_ord, trim(o.attribute, ' ') AS attribute, o.value FROM once o WHERE trim(o.attribute, ' ') <> ''"""
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables in long form without repeats."""
    once = read_table(spark, d, "spec_cells").groupBy("table_id", "attr_ord", "ent_ord").agg(F.max("attribute").alias("attribute"), F.max(F.coalesce("value", F.lit(""))).alias("value"))
    return once.where(F.trim("attribute") != "").select("table_id", "ent_ord", "attr_ord", F.trim("attribute").alias("attribute"), "value")


_ROWS = f"""{_GRID}, ents AS (SELECT table_id, ent_ord, max(entity) AS entity, row_number() OVER (PARTITION BY table_id ORDER BY ent_ord) AS i FROM once GROUP BY table_id, ent_ord),
    lines AS (SELECT table_id, attr_ord, max(coalesce(attribute, '')) AS label, bool_and(trim(value, ' ') = '') AS bare FROM once GROUP BY ALL)"""
_START = "list_max(list_filter(range(0, least(length(list_min({k})), length(list_max({k}))) + 1), lambda i: substr(list_min({k}), 1, i) = substr(list_max({k}), 1, i)))"


def _axis_sql(cells: str) -> tuple[str, str, str]:
    """Shared start, share with digits and mean length of a list of cells."""
    kept = f"list_filter({cells}, lambda c: c <> '')"
    start = f"length(trim(substr(list_min({kept}), 1, {_START.replace('{k}', kept)}), ' '))"
    letters = f"list_sum(list_transform({kept}, lambda c: length(c)))"
    share = f"CASE WHEN len({kept}) < 2 OR {start} < 3 THEN 0.0::DOUBLE ELSE {start} / ({letters} / len({kept})) END"
    digits = f"CASE WHEN len({kept}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({kept}, lambda c: regexp_matches(c, '[0-9]'))) / len({kept}) END"
    return share, digits, f"list_sum(list_transform({cells}, lambda c: length(c))) / greatest(len({cells}), 1)"


def _orientation_sql() -> str:
    (rp, rd, rl), (cp, cd, cl) = _axis_sql("r"), _axis_sql("c")
    scored = f"""SELECT table_id, r, c, sections, {rp} AS rp, {rd} AS rd, {rl} AS rl, {cp} AS cp, {cd} AS cd, {cl} AS cl FROM g"""
    sign = lambda a, b, w, gap: f"CASE WHEN {a} + {gap} < {b} THEN {w}::DOUBLE WHEN {b} + {gap} < {a} THEN -{w}::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""WITH {_ROWS}, g AS (SELECT table_id, (SELECT list(e.entity ORDER BY e.i) FROM ents e WHERE e.table_id = l.table_id) AS r, list(label ORDER BY attr_ord) AS c, count(*) FILTER (bare AND trim(label, ' ') <> '') AS sections FROM lines l GROUP BY table_id),
    m AS ({scored}), s AS (SELECT *, 0.15::DOUBLE + CASE WHEN cp > rp + 0.15 THEN 0.45::DOUBLE WHEN rp > cp + 0.15 THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END + {sign('rd', 'cd', '0.25', '0.15')} + {sign('rl', 'cl', '0.2', '10')} AS score FROM m)
    SELECT table_id, CASE WHEN len(list_filter(r, lambda c: trim(c, ' ') <> '')) = 0 OR sections >= 2 OR score <= 0 THEN 'attribute_major' ELSE 'variant_major' END AS orientation,
    CASE WHEN len(list_filter(r, lambda c: trim(c, ' ') <> '')) = 0 THEN 0.9 WHEN sections >= 2 THEN 0.85 ELSE least(abs(score), 1.0) END::DOUBLE AS confidence FROM s"""


@query(_orientation_sql())
def table_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Which axis of each table names the attributes."""
    g = grids.cells_to_grids(read_table(spark, d, "spec_cells"), "table_id")
    return g.select("table_id", grids.orientation(F.col("grid")).alias("o")).select("table_id", "o.orientation", "o.confidence")


@query(
    f"""WITH {_ROWS}, sec AS (SELECT *, trim(label, ' ') AS lab, bare AND trim(label, ' ') <> '' AS is_sec FROM lines), w AS (SELECT *, coalesce(last_value(CASE WHEN is_sec THEN lab END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY attr_ord), '') AS section FROM sec),
    k AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY attr_ord) AS n FROM w WHERE NOT is_sec AND lab <> '')
    SELECT k.table_id, CAST(e.i AS INT) AS ent_ord, e.entity, CAST(k.n AS INT) AS attr_ord, k.lab AS attribute, coalesce(o.value, '') AS value, k.section FROM k JOIN ents e ON e.table_id = k.table_id LEFT JOIN once o ON o.table_id = k.table_id AND o.attr_ord = k.attr_ord AND o.ent_ord = e.ent_ord"""
)
def table_records(spark: SparkSession, d: str) -> DataFrame:
    """Grids read as records: entity, attribute, value, section; the axis is the known one."""
    g = grids.cells_to_grids(read_table(spark, d, "spec_cells"), "table_id")
    return grids.grid_records(g, "table_id", "grid", F.lit("attribute_major"))


@query(
    rf"""WITH {_ROWS}, h AS (SELECT table_id, list_distinct(flatten(list(list_filter(string_split_regex(lower(trim(entity, ' ')), '[^a-zä-ÿ]+'), lambda w: w <> '')))) AS words, count(*) + 1 AS width FROM ents GROUP BY table_id),
    cols AS (SELECT o.table_id, e.i, o.value AS v FROM once o JOIN ents e USING (table_id, ent_ord) UNION ALL SELECT table_id, 0, label FROM lines),
    t AS (SELECT table_id, i, count(*) FILTER (trim(v, ' ') <> '') AS n, count(*) FILTER (trim(v, ' ') <> '' AND regexp_matches(trim(v, ' '), '{grids.LANGUAGE}')) AS la, count(*) FILTER (trim(v, ' ') <> '' AND regexp_matches(trim(v, ' '), '{grids.FILE_SIZE}')) AS fs,
    count(*) FILTER (regexp_matches(v, '(?i)^\s*[A-Z0-9]{{2,}}[-./][A-Z0-9]{{2,}}[-./][A-Z0-9]{{1,}}\s*$') AND regexp_matches(v, '^\s*[A-Za-z0-9]*[0-9]') AND NOT regexp_matches(trim(v, ' '), '{T.DATE_START}')) AS oc FROM cols GROUP BY ALL)
    SELECT t.table_id, bool_or(n >= 2 AND (la >= n * 0.6 OR fs >= n * 0.6)) OR max(len(list_intersect(words, [{', '.join(repr(w) for w in grids.STRONG)}]))) > 0 OR max(CASE WHEN width <= 4 THEN len(list_intersect(words, [{', '.join(repr(w) for w in grids.WEAK)}])) ELSE 0 END) >= 2 AS no_spec,
    bool_or(i <= 1 AND n > 0 AND oc >= greatest(2, n * 0.5)) AS order_list FROM t JOIN h USING (table_id) GROUP BY t.table_id"""
)
def table_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tables that hold no specifications, or order codes."""
    g = grids.cells_to_grids(read_table(spark, d, "spec_cells"), "table_id")
    return g.select("table_id", grids.is_no_spec_table(F.col("grid")).alias("no_spec"), grids.is_order_list(F.col("grid")).alias("order_list"))


@query(
    rf"""WITH p AS (SELECT p_partkey, p_type, p_brand, p_size FROM part), k AS (SELECT p_partkey, p_type || '-' || p_brand || ' ' || p_size AS name, p_brand AS t FROM p)
    SELECT t AS brand, min(p_partkey) AS first_ord, count(*) AS members FROM (SELECT p_partkey, p_brand AS t, p_type, p_size FROM p) GROUP BY t, p_type, p_size"""
)
def device_groups(spark: SparkSession, d: str) -> DataFrame:
    """Variants of one brand that differ only in price are one device."""
    p = read_table(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", F.lit("Unit"), F.translate("p_type", " #%&/", "     "), F.concat(F.lit("s"), F.col("p_size"))).alias("name"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("List price"), F.col("p_retailprice").cast("string")).alias("specs"))
    g = identity.group_variants(p, "p_brand", "p_partkey", "name", "specs")
    return g.select(F.col("p_brand").alias("brand"), "first_ord", F.size("variants").cast("bigint").alias("members"))


_WORDS = "trim(regexp_replace(lower(trim(label)), '[^a-z0-9 ]+', ' ', 'g'))"


@query(f"SELECT spec_id, {_WORDS} = '' OR (NOT regexp_matches({_WORDS}, '{ALTERNATIVES(identity.FUNCTIONAL)}') AND regexp_matches({_WORDS}, '{ALTERNATIVES(identity.COSMETIC)}')) AS cosmetic FROM spec_values")
def cosmetic_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes whose difference alone makes no other device."""
    return read_table(spark, d, "spec_values").select("spec_id", identity.is_cosmetic(F.col("label")).alias("cosmetic"))


@query()
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records of one device on several pages as one row."""
    r = spread(read_table(spark, d, "device_records").select(F.col("listing_id").alias("record_id"), "name", "url", "specs"))
    return identity.merge_pages(r)


@query(
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY url) AS k FROM device_records WHERE specs IS NOT NULL), s AS (SELECT url, min(fetch_id) AS f FROM fetch_index GROUP BY url)
    SELECT n.listing_id, cardinality(n.specs) + CASE WHEN k = 1 AND s.url IS NOT NULL AND list_contains(map_keys(n.specs), 'release_date') THEN 1 WHEN k = 1 AND s.url IS NOT NULL THEN 2 ELSE 0 END AS n_specs FROM n LEFT JOIN s ON s.url = n.url"""
)
def datasheet_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Specs filled from a sheet of the same URL where exactly one record has it."""
    sheets = read_table(spark, d, "fetch_index").groupBy("url").agg(F.min("fetch_id").alias("f")).select("url", F.create_map(F.lit("sheet_id"), F.col("f").cast("string"), F.lit("release_date"), F.lit("2020-01-01")).alias("sheet"))
    records = read_table(spark, d, "device_records").where(F.col("specs").isNotNull())
    return identity.fill_gaps(records, sheets, "url", "specs").select("listing_id", F.size("specs").cast("bigint").alias("n_specs"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), ())")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums per stage and over all."""
    return logs.totals(read_table(spark, d, "events"), "event_type", "value")


@query("WITH s AS (SELECT user_id, round(sum(value), 4) AS t FROM events GROUP BY user_id) SELECT count(*) AS sources, round(median(t), 4) AS median, min(t) AS least, max(t) AS most FROM s")
def log_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median and range of the sums per source."""
    return logs.spread_of_totals(read_table(spark, d, "events"), "user_id", "value")


@query("SELECT event_id, spent_before FROM (SELECT event_id, coalesce(round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4), 0.0) AS spent_before FROM events) WHERE spent_before < 200")
def log_budget(spark: SparkSession, d: str) -> DataFrame:
    """Rows up to and with the one that oversteps a budget per source."""
    return logs.within_budget(read_table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 200.0).select("event_id", "spent_before")


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 600 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM m) SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM n GROUP BY user_id, session"""
)
def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a source's rows without a gap of over ten minutes."""
    return logs.sessions(read_table(spark, d, "events"), "user_id", "ts").select("user_id", "session", "n", "started", "ended")


@query("SELECT listing_id FROM device_records d WHERE NOT EXISTS (SELECT 1 FROM fetch_index f WHERE f.url = d.url AND f.body_path IS NOT NULL)")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose page was never stored."""
    done = read_table(spark, d, "fetch_index").where(F.col("body_path").isNotNull())
    return logs.pending(read_table(spark, d, "device_records"), done, "url").select("listing_id")


@query(
    """WITH v AS (SELECT url, role, row_number() OVER (PARTITION BY url ORDER BY decided_at DESC, entry_id DESC) AS rn FROM scope_entries) SELECT d.listing_id, coalesce(v.role, 'unknown') AS label, CASE WHEN v.role IS NOT NULL THEN 'recorded' ELSE 'signals' END AS decided_by FROM device_records d LEFT JOIN v ON v.url = d.url AND v.rn = 1"""
)
def recorded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Records with the last decision recorded for their address in place of their own label."""
    items = read_table(spark, d, "device_records").select("listing_id", "url", F.lit("unknown").alias("label"))
    verdicts = read_table(spark, d, "scope_entries").select("url", F.col("role").alias("label"), "decided_at", "entry_id")
    return logs.resolved(items, verdicts, "url", "label", [F.col("decided_at"), F.col("entry_id")]).select("listing_id", "label", "decided_by")


@query(
    "SELECT fetch_id, '<urlset><url><loc>' || replace(final_url, '&', '&amp;') || '</loc></url></urlset>' IS NOT NULL AS is_map, final_url AS loc, fetched_at AS lastmod FROM fetch_index"
)
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap text, made of the fetch log, read back."""
    body = F.concat(F.lit("<urlset><url><loc>"), F.replace("final_url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.col("fetched_at"), F.lit("</lastmod></url></urlset>"))
    t = read_table(spark, d, "fetch_index").withColumn("body", body)
    return t.select("fetch_id", R.is_sitemap(F.col("body")).alias("is_map"), F.explode(R.sitemap_entries(F.col("body"))).alias("e")).select("fetch_id", "is_map", "e.loc", "e.lastmod")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    first = read_table(spark, d, "fetch_index").where(F.col("body_path").isNotNull()).groupBy("body_path").agg(F.min("url").alias("url"))
    bodies = read_table(spark, d, "page_bodies").join(first, "body_path", "left").withColumn("url", F.coalesce("url", F.lit("")))
    return with_page(bodies.select("body_id", "url", "html"), "html", "url").drop("html")


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of stored pages: address, text, menu path, region; junk, assets and documents left out."""
    links = _parsed(spark, d).select("body_id", F.posexplode("parsed.links").alias("ord", "l"))
    u = F.col("l.href")
    kept = links.where(U.is_menu_link(u, F.col("l.text")))
    return kept.select("body_id", "ord", U.canonical(u).alias("url"), T.clean_link_text(F.col("l.text")).alias("text"), F.array_join("l.trail", " > ").alias("trail"), "l.region")


@query()
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Structural signs and label of stored pages."""
    from skarn.operators.signals import score

    p = page_signals(_parsed(spark, d))
    s = F.col("sig")
    label = score(s["has_spec"], s["has_order"], F.size(s["order_numbers"]) > 0, s["has_product"], s["pdf_links"] > 0, s["depth"] == 4, F.lit(False), s["editorial"], F.lit(0.05))
    return p.withColumn("l", label).select("body_id", "sig.depth", "sig.h1", "sig.table_count", "sig.has_spec", "sig.text_length", "l.score", "l.label")


@query()
def page_digests(spark: SparkSession, d: str) -> DataFrame:
    """Shortened titles, headings and openings of stored pages."""
    return digest(_parsed(spark, d)).select("body_id", "digest.title", "digest.h1", F.array_join("digest.headings", " | ").alias("headings"), "digest.intro")


@query()
def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of stored pages: the best table of each read as records, values parsed."""
    return extract.page_records(_parsed(spark, d), "body_id").select("body_id", "ent_ord", "entity", "attribute_key", "raw", "spec.kind", "spec.value", "spec.unit")


@query("SELECT entry_id, " + f"CASE WHEN regexp_matches(lower({_p('path')}), '{ALTERNATIVES(U.CATALOGUE_HINTS)}') AND NOT regexp_matches({_p('path')}, '{U.EDITORIAL}') AND NOT coalesce(regexp_matches(lower(name), 'service|support|news|career|about|contact|software|training'), false) THEN true ELSE false END AS in_scope FROM scope_entries")
def scope_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Menu entries that their words and addresses put into the catalogue."""
    return extract.scope_by_words(read_table(spark, d, "scope_entries"), "name", "url").select("entry_id", F.coalesce("in_scope", F.lit(False)).alias("in_scope"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x FROM documents), m AS (SELECT doc_id, trim(regexp_extract(x, '{T.SHEET_LINE}', 1), ' ') AS label, trim(regexp_extract(x, '{T.SHEET_LINE}', 2), ' ') AS value FROM l WHERE regexp_matches(x, '{T.SHEET_LINE}'))
    SELECT doc_id, label, value FROM m WHERE regexp_matches(value, '[0-9]')"""
)
def sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label and value lines of whole texts, as data sheets have them."""
    return read_table(spark, d, "documents").select("doc_id", F.explode(T.sheet_pairs(F.col("text"))).alias("p")).select("doc_id", "p.label", "p.value")


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Specifications written as text in stored pages: heading, label and value of each page's best section."""
    from skarn.sources.sections import section_pairs, with_outline

    return section_pairs(with_outline(read_table(spark, d, "page_bodies").select("body_id", "html"), "html").drop("html"), "body_id")


@query()
def menu_scope(spark: SparkSession, d: str) -> DataFrame:
    """Menu entries of stored pages that are in the catalogue's scope, per site."""
    from skarn.plans.scope import menu_scope as scope

    links = _parsed(spark, d).select(U.host(F.col("url")).alias("site"), F.explode("parsed.links").alias("l")).select("site", "l.*")
    return scope(links)


_PLATFORM = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(html, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in R.PLATFORMS.items()) + " ELSE '' END"


@query(r"SELECT body_id, " + _PLATFORM + r" AS platform, regexp_matches(html, '" + T.CHALLENGE + "') AS challenge, (lower(substr(html, 1, 2048)) LIKE '%<urlset%' OR lower(substr(html, 1, 2048)) LIKE '%<sitemapindex%' OR lower(substr(html, 1, 2048)) LIKE '%<loc>%') AS sitemap FROM page_bodies")
def body_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are a check on visitors, or a sitemap."""
    return read_table(spark, d, "page_bodies").select("body_id", F.coalesce(R.platform(F.col("html")), F.lit("")).alias("platform"), T.is_challenge(F.col("html")).alias("challenge"), R.is_sitemap(F.col("html")).alias("sitemap"))


@query()
def product_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links of each stored page's content that are no editorial pages, documents or the page itself."""
    links = _parsed(spark, d).select("body_id", "url", F.explode("parsed.links").alias("l")).where(F.col("l.region") == "body")
    u = F.col("l.href")
    kept = links.where(U.is_menu_link(u, F.col("l.text")) & ~U.is_editorial(u) & ~U.is_document(u) & (U.page_key(u) != U.page_key(F.col("url"))))
    return kept.groupBy("body_id").agg(F.countDistinct(U.page_key(u)).alias("links"))
