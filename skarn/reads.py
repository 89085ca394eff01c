"""Queries over the reports, choices and lookups of ``operators.reports``, each with its SQL; they join the registry of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.functions import urls as U
from skarn.operators import inventory, reports
from skarn.queries import _p, _parsed, query
from skarn.session import read_table

_JOINED = "array_to_string({x}, '; ')"
_HOST = "regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':[0-9]+$', '')"
_BRANCH = "'/' || array_to_string({s}[1:greatest(len({s}) - 1, 0)], '/')"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$')))"


@query(
    f"""WITH s AS (SELECT url, {_p('seg')} AS seg FROM fetch_index), h AS (SELECT 'host' AS kind, {_HOST.format(u='url')} AS name, count(*) AS count FROM fetch_index GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3),
    e AS (SELECT unnest(list_transform(range(1, least(len(seg), 3) + 1), lambda i: '/' || array_to_string(seg[1:i], '/'))) AS name FROM s WHERE len(seg) > 0),
    b AS (SELECT 'branch' AS kind, name, count(*) AS count FROM e GROUP BY 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 2 LIMIT 70) SELECT * FROM h UNION ALL SELECT * FROM b"""
)
def url_tree(spark: SparkSession, d: str) -> DataFrame:
    """The largest hosts and path prefixes of all fetched URLs."""
    return reports.url_tree(read_table(spark, d, "fetch_index"), "url")


@query(
    """WITH p AS (SELECT vendor, count(DISTINCT url) AS pages FROM device_records GROUP BY vendor), l AS (SELECT DISTINCT vendor, url, document FROM (SELECT vendor, url, unnest(datasheet_urls) AS document FROM device_records))
    SELECT l.vendor, document FROM l JOIN p USING (vendor) GROUP BY l.vendor, document, pages HAVING count(*) >= 3 AND count(*) >= pages * 0.2"""
)
def site_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a site links from everywhere."""
    return reports.site_furniture(read_table(spark, d, "device_records"), "vendor", "url", "datasheet_urls")


_DOMAIN = "CASE WHEN len({l}) >= 3 AND {l}[-2] IN ('co','com','net','org','ac','gov') THEN array_to_string({l}[-3:], '.') ELSE array_to_string({l}[-2:], '.') END"


@query(
    f"""WITH p AS (SELECT vendor, count(DISTINCT url) AS pages FROM device_records GROUP BY vendor), l AS (SELECT DISTINCT vendor, url, document FROM (SELECT vendor, url, unnest(datasheet_urls) AS document FROM device_records)),
    c AS (SELECT l.vendor, document FROM l JOIN p USING (vendor) GROUP BY l.vendor, document, pages HAVING count(*) >= 3 AND count(*) >= pages * 0.2),
    x AS (SELECT listing_id, vendor, name, unnest(datasheet_urls) AS document, generate_subscripts(datasheet_urls, 1) AS i FROM device_records),
    y AS (SELECT *, regexp_extract(regexp_replace(document, '[?#].*$', ''), '([^/]*)$', 1) || ' ' AS f, list_filter(string_split(lower({_HOST.format(u='document')}), '.'), lambda a: a <> '') AS dl, list_filter(string_split(lower(vendor), '.'), lambda a: a <> '') AS vl FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.vendor = x.vendor AND c.document = x.document)),
    z AS (SELECT *, CASE WHEN regexp_matches(f, '{T.SHEET_BAD}') THEN -1 WHEN regexp_matches(f, '{T.SHEET_GOOD}') THEN 2 ELSE 0 END AS base FROM y),
    s AS (SELECT listing_id, document, i, base + CASE WHEN {_DOMAIN.format(l='dl')} = {_DOMAIN.format(l='vl')} THEN 1 ELSE 0 END + least(4, 2 * len(list_intersect(list_filter({_words("coalesce(name, '')")}, lambda w: w NOT IN ('the', 'and', 'for', 'system', 'series')), {_words(_p('path', 'document'))}))) AS score FROM z WHERE base >= 0),
    m AS (SELECT listing_id, arg_max(document, (score, -i)) AS document, max(score) AS score, count(*) AS n FROM s GROUP BY listing_id) SELECT listing_id, document, CAST(score AS INT) AS score FROM m WHERE score >= 1 OR n = 1"""
)
def datasheet_choice(spark: SparkSession, d: str) -> DataFrame:
    """The data sheet of each record: by file name, domain and shared words, without the site's furniture."""
    return reports.choose_datasheet(read_table(spark, d, "device_records"), "listing_id", "vendor", "url", "name", "datasheet_urls").select("listing_id", "document", F.col("score").cast("int").alias("score"))


@query(
    """WITH f AS (SELECT f.vendor, count(*) AS fetches, count(DISTINCT f.url) AS urls, count(DISTINCT final_url) AS pages, count(b.body_id) AS stored, count(*) FILTER (f.body_path IS NOT NULL AND b.body_id IS NULL) AS lost, count(*) FILTER (source = 'archive') AS from_archive,
    count(*) FILTER (source = 'blocked') AS blocked, count(*) FILTER (status >= 400) AS refused, count(*) FILTER (f.url <> final_url) AS redirected, min(fetched_at) AS first_at, max(fetched_at) AS last_at FROM fetch_index f LEFT JOIN page_bodies b ON f.body_path = b.body_path GROUP BY f.vendor),
    s AS (SELECT vendor, count(*) FILTER (role = 'product') AS products_named, count(*) FILTER (role = 'hub') AS hubs_named, count(DISTINCT url) AS scope_urls FROM scope_entries GROUP BY vendor)
    SELECT f.*, coalesce(products_named, 0) AS products_named, coalesce(hubs_named, 0) AS hubs_named, coalesce(scope_urls, 0) AS scope_urls FROM f LEFT JOIN s USING (vendor)"""
)
def scan_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the scan of each site came to."""
    return reports.scan_manifest(read_table(spark, d, "fetch_index"), read_table(spark, d, "page_bodies"), read_table(spark, d, "scope_entries"))


@query(
    """WITH n AS (SELECT vendor, count(*) AS records, count(DISTINCT url) AS pages, count(*) FILTER (coalesce(cardinality(specs), 0) > 0) AS with_specs, count(*) FILTER (len(source_variants) > 1) AS merged_groups, count(*) FILTER (len(interfaces) > 0) AS with_interfaces FROM device_records GROUP BY vendor),
    k AS (SELECT vendor, count(DISTINCT a) AS attributes FROM (SELECT vendor, unnest(map_keys(specs)) AS a FROM device_records) GROUP BY vendor) SELECT n.*, coalesce(attributes, 0) AS attributes FROM n LEFT JOIN k USING (vendor)"""
)
def extract_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the extraction of each site came to."""
    return reports.extract_summary(read_table(spark, d, "device_records"))


@query(
    """WITH v AS (SELECT DISTINCT url FROM scope_entries), l AS (SELECT d.vendor, v.url IS NULL AS u FROM device_records d LEFT JOIN v ON v.url = d.url)
    SELECT vendor, count(*) AS items, count(*) FILTER (u) AS unknown, round(count(*) FILTER (u) / greatest(count(*), 1), 6) AS rate FROM l GROUP BY vendor"""
)
def escalation_rate(spark: SparkSession, d: str) -> DataFrame:
    """The share of each site's records that no recorded decision labels."""
    decided = read_table(spark, d, "scope_entries").select("url").distinct().withColumn("label", F.lit("known"))
    return reports.escalation(read_table(spark, d, "device_records").join(decided, "url", "left").withColumn("label", F.coalesce("label", F.lit("unknown"))), "vendor")


@query("SELECT vendor, string_agg(category, '|' ORDER BY category) AS categories FROM (SELECT DISTINCT vendor, category FROM device_records WHERE trim(category, ' ') <> '') GROUP BY vendor")
def category_lists(spark: SparkSession, d: str) -> DataFrame:
    """The distinct categories of each site."""
    return reports.category_lists(read_table(spark, d, "device_records"), "vendor", "category").select("vendor", F.array_join("categories", "|").alias("categories"))


@query(
    """WITH y AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS a FROM events GROUP BY ALL)
    SELECT user_id, day, CAST(sum(n) OVER w AS BIGINT) AS calls, round(sum(a) OVER w, 4) AS amount FROM y WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)"""
)
def running_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and amounts of each user so far, day by day."""
    return reports.running_usage(read_table(spark, d, "events"), "user_id", "ts", "value")


@query(
    "SELECT listing_id, coalesce(name, '') AS name, coalesce(category, '') AS category, substr(coalesce(description, ''), 1, 160) AS description, coalesce(array_to_string(datasheet_urls[1:2], '; '), '') AS datasheets, coalesce(cardinality(specs), 0) || ' keys' AS specs FROM device_records"
)
def device_table(spark: SparkSession, d: str) -> DataFrame:
    """The device table as it is read, specifications as their number."""
    return reports.device_table(read_table(spark, d, "device_records"))


@query("WITH k AS (SELECT lower(trim(name, ' ')) AS key, listing_id, specs FROM device_records) SELECT key, min(listing_id) AS listing_id, coalesce(cardinality(arg_min(specs, listing_id)), 0)::INT AS n_specs FROM k WHERE key <> '' GROUP BY key")
def specs_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The first record of every name, whatever its case."""
    got = reports.specs_by_name(read_table(spark, d, "device_records"), "name", "listing_id")
    return got.select("key", "listing_id", F.coalesce(F.size("specs"), F.lit(0)).alias("n_specs"))


@query("SELECT l.product_id, place, spec_id FROM (SELECT product_id, min(listing_id) AS place FROM device_records GROUP BY 1) l JOIN (SELECT product_id, min(spec_id) AS spec_id FROM spec_values GROUP BY 1) e USING (product_id)")
def listed_order(spark: SparkSession, d: str) -> DataFrame:
    """The first specification of each product, by the product's place in the list of devices."""
    return reports.in_order_of(read_table(spark, d, "spec_values"), read_table(spark, d, "device_records"), "product_id", "listing_id", "spec_id").select("product_id", "place", "spec_id")


@query("SELECT fetch_id FROM fetch_index WHERE url IN (SELECT url FROM scope_entries WHERE role = 'product')")
def accepted_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Fetches of the pages that the scope names as products."""
    return reports.accepted(read_table(spark, d, "fetch_index"), read_table(spark, d, "scope_entries").where(F.col("role") == "product"), "url").select("fetch_id")


@query("SELECT listing_id FROM device_records WHERE cardinality(specs) > 0")
def device_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records that have a specification."""
    return read_table(spark, d, "device_records").where(reports.has_specs(F.col("specs"))).select("listing_id")


@query(
    r"""WITH a AS (SELECT listing_id, url, name, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(name, ''), '\s*[▶►▸›»→➔]+\s*$', ''), '\s+([®™©])', '\1', 'g'), '\s+TM\b', '™', 'g')) AS t FROM device_records),
    b AS (SELECT *, trim(regexp_replace(t, '[\s\x{00a0}]+', ' ', 'g')) AS label FROM a), c AS (SELECT *, regexp_replace(label, '\s*[A-Z]{0,4}\d[\dA-Za-z]*(?:-[\dA-Za-z]+){2,}\s*$', '') AS v FROM b),
    e AS (SELECT *, CASE WHEN contains(v, ' | ') AND length(trim(split_part(v, ' | ', 1))) >= 3 THEN trim(split_part(v, ' | ', 1)) WHEN contains(v, ' - ') AND length(trim(split_part(v, ' - ', 1))) >= 3 THEN trim(split_part(v, ' - ', 1))
    WHEN contains(v, ' – ') AND length(trim(split_part(v, ' – ', 1))) >= 3 THEN trim(split_part(v, ' – ', 1)) WHEN contains(v, ' — ') AND length(trim(split_part(v, ' — ', 1))) >= 3 THEN trim(split_part(v, ' — ', 1)) ELSE v END AS h FROM c),
    f AS (SELECT listing_id, url, trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'), ' ') AS plain, regexp_replace(h, '^[ –—:,-]+|[ –—:,-]+$', '', 'g') AS clean FROM e),
    g AS (SELECT *, count(*) OVER (PARTITION BY url, clean) AS same, row_number() OVER (PARTITION BY url ORDER BY listing_id) AS place FROM f), n AS (SELECT *, CASE WHEN same > 1 AND plain <> '' THEN plain ELSE clean END AS d FROM g)
    SELECT listing_id, CASE WHEN d = '' THEN coalesce(url, 'null') || ' variant ' || place ELSE d END AS device FROM n"""
)
def names_apart(spark: SparkSession, d: str) -> DataFrame:
    """Names of devices that stay distinct on their page."""
    return reports.names_apart(read_table(spark, d, "device_records"), "url", "name", "listing_id").select("listing_id", "device")


@query(
    "SELECT table_id, trim(attribute, ' ') || ' (' || coalesce(entity, '') || ')' AS attribute, max(value) AS value FROM spec_cells WHERE trim(attribute, ' ') <> '' AND trim(value, ' ') <> '' GROUP BY 1, 2"
)
def flattened_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables read as one device each, attributes told apart by entity."""
    return reports.flattened(read_table(spark, d, "spec_cells"), "table_id")


@query(
    """WITH o AS (SELECT vendor, url, arg_min(role, (CASE WHEN role = 'product' THEN 0 ELSE 1 END, ord, entry_id)) AS role FROM scope_entries GROUP BY ALL), w AS (SELECT vendor, coalesce(max(decided_by) FILTER (decided_by = 'model'), min(decided_by)) AS decided_by FROM scope_entries GROUP BY vendor)
    SELECT o.vendor, url, role, decided_by FROM o JOIN w USING (vendor)"""
)
def scope_union(spark: SparkSession, d: str) -> DataFrame:
    """The scope decisions of each site as one."""
    return reports.union_of_scopes(read_table(spark, d, "scope_entries"))


_KEY = "regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(" + _p("path") + ", '/+$', '')"


@query(
    f"""WITH a AS (SELECT 0 AS r, url, 'menu' AS via FROM scope_entries WHERE role = 'product' UNION ALL SELECT 1, url, 'hub' FROM scope_entries WHERE role = 'hub' UNION ALL SELECT 2, url, 'sitemap' FROM fetch_index)
    SELECT {_KEY.format(u='url')} AS key, arg_min(url, (r, url, via)) AS url, arg_min(via, (r, url, via)) AS via FROM a GROUP BY 1"""
)
def frontier_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Pages of menus, hubs and the inventory, each once, the first source first."""
    scope = read_table(spark, d, "scope_entries")
    return reports.seeds(("menu", scope.where(F.col("role") == "product")), ("hub", scope.where(F.col("role") == "hub")), ("sitemap", read_table(spark, d, "fetch_index")))


@query(
    f"""WITH s AS (SELECT fetch_id, url, {_p('seg')} AS seg FROM fetch_index), u AS (SELECT url, bool_or(role = 'product') AS keep FROM scope_entries GROUP BY url), h AS (SELECT {_BRANCH.format(s='seg')} AS branch, bool_or(role = 'product') AS keep FROM (SELECT role, {_p('seg')} AS seg FROM scope_entries) GROUP BY 1)
    SELECT fetch_id, coalesce(u.keep, h.keep) AS keep, CASE WHEN u.keep IS NOT NULL THEN 'url' WHEN h.keep IS NOT NULL THEN 'branch' END AS by FROM s LEFT JOIN u USING (url) LEFT JOIN h ON h.branch = {_BRANCH.format(s='s.seg')}"""
)
def remembered_links(spark: SparkSession, d: str) -> DataFrame:
    """Fetched URLs with the decision stored for their address or the path above it."""
    scope = read_table(spark, d, "scope_entries")
    keep = F.bool_or(F.col("role") == "product").alias("keep")
    seg = U.segments(F.col("url"))
    branch = F.concat(F.lit("/"), F.array_join(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), "/"))
    return reports.remembered(read_table(spark, d, "fetch_index").select("fetch_id", "url"), "url", scope.groupBy("url").agg(keep), scope.groupBy(branch.alias("branch")).agg(keep)).select("fetch_id", "keep", "by")


_NAME = "coalesce(regexp_extract(" + _p("path", "u") + ", '([^/]*)$', 1), '') || '?' || regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?[^?#]*(?:\\?([^#]*))?', 1)"


@query(
    f"""WITH m AS (SELECT vendor, regexp_extract(url, '^[^/]*//[^/]*/[^/]*/[^/]*', 0) AS u, count(*) AS n FROM fetch_index GROUP BY ALL), p AS (SELECT *, CASE WHEN regexp_matches({_NAME}, '{U.SITEMAP_LAST}') THEN 2 WHEN regexp_matches({_NAME}, '{U.SITEMAP_FIRST}') THEN 0 ELSE 1 END AS priority FROM m),
    w AS (SELECT vendor, u AS sitemap, priority, row_number() OVER o AS place, CAST(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS found, n FROM p WINDOW o AS (PARTITION BY vendor ORDER BY priority, u)) SELECT vendor, sitemap, priority, CAST(place AS INT) AS place, found FROM w WHERE place <= 4 AND found - n < 40"""
)
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps, here one per catalogue prefix of a site, that a walk with two budgets reads."""
    maps = read_table(spark, d, "fetch_index").groupBy("vendor", F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*/[^/]*", 0).alias("sitemap")).agg(F.count("*").alias("n"))
    maps = maps.withColumn("priority", U.sitemap_priority(F.col("sitemap"), F.lit("")))
    return reports.walk_sitemaps(maps, "vendor", [F.col("priority"), F.col("sitemap")], "n", 4, 40).select("vendor", "sitemap", "priority", "place", "found")


@query(
    "WITH f AS (SELECT listing_id, list_filter([" + ", ".join(f"CASE WHEN {'len(' + c + ') > 0' if c in ('datasheet_urls', 'interfaces', 'source_variants', 'regional_variants', 'warnings') else 'cardinality(' + c + ') > 0' if c == 'specs' else c + chr(32) + '<> ' + repr('')} THEN '{c}' END" for c in ["product_id", "manufacturer", "name", "category", "description", "image_url", "datasheet_urls", "interfaces", "specs", "source_variants", "regional_variants", "merge_reason", "warnings"]) + "], lambda x: x IS NOT NULL) AS l FROM device_records) SELECT listing_id, array_to_string(l, ' ') AS fields FROM f"
)
def filled_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that each record's dictionary keeps."""
    names = ["product_id", "manufacturer", "name", "category", "description", "image_url", "datasheet_urls", "interfaces", "specs", "source_variants", "regional_variants", "merge_reason", "warnings"]
    return reports.filled_fields(read_table(spark, d, "device_records"), "listing_id", names).select("listing_id", F.array_join("fields", " ").alias("fields"))


@query(
    f"""WITH p AS (SELECT vendor, url, CASE WHEN regexp_matches(lower({_p('path')}), '{'|'.join(U.CATALOGUE_HINTS)}') THEN 0 WHEN regexp_matches(lower({_p('path')}), '{'|'.join(U.EDITORIAL_HINTS)}') THEN 2 ELSE 1 END AS priority, len({_p('seg')}) AS depth FROM (SELECT DISTINCT vendor, url FROM fetch_index)),
    n AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY depth, priority, url) AS k FROM p) SELECT vendor, url, CAST(priority AS INT) AS priority FROM n WHERE k <= 25"""
)
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each site that a crawl with a page budget visits: by depth, then priority, then address."""
    pages = read_table(spark, d, "fetch_index").select("vendor", "url").distinct().withColumn("priority", U.crawl_priority(F.col("url")))
    return reports.top_per_key(pages, ["vendor"], [U.depth(F.col("url")), F.col("priority"), F.col("url")], 25).select("vendor", "url", F.col("priority").cast("int").alias("priority"))


@query(
    f"""SELECT fetch_id, CASE WHEN len(d) >= 1 AND {_DOMAIN.format(l='d')} = {_DOMAIN.format(l='v')} THEN true ELSE false END AS same_vendor, (h = lower(vendor) AND starts_with({_p('path', 'final_url')}, '/en')) OR (h = 'www.labmarkt.example' AND starts_with({_p('path', 'final_url')}, '/de')) AS listed
    FROM (SELECT fetch_id, final_url, vendor, regexp_extract(final_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS h, list_filter(string_split(lower({_HOST.format(u='final_url')}), '.'), lambda a: a <> '') AS d, list_filter(string_split(lower(vendor), '.'), lambda a: a <> '') AS v FROM fetch_index)"""
)
def link_sides(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fetch ended on the vendor's own domain, and under one of two listed prefixes."""
    f = read_table(spark, d, "fetch_index")
    same = U.same_vendor(U.part(F.col("final_url"), 2), F.col("vendor"))
    return f.select("fetch_id", same.alias("same_vendor"), inventory.prefix_matches(f, "final_url", ["/en*", "www.labmarkt.example/de*"], F.lower("vendor")).alias("listed"))


@query(
    r"""WITH h AS (SELECT listing_id, regexp_replace(regexp_replace(lower(coalesce(manufacturer, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS m, regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS n, """
    + f"coalesce({_p('seg')}[-1], '') AS s"
    + " FROM device_records) SELECT listing_id, m || '__' || s || CASE WHEN n <> '' AND n <> s THEN '__' || n ELSE '' END AS id FROM h"
)
def product_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of maker, last path segment and name."""
    r = read_table(spark, d, "device_records")
    return r.select("listing_id", T.product_id(F.coalesce("manufacturer", F.lit("")), F.coalesce(U.slug(F.col("url")), F.lit("")), F.coalesce("name", F.lit(""))).alias("id"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)\{.*\}'), ''), nullif(regexp_extract(text, '(?s)\[.*\]'), '')) AS reply FROM documents")
def json_spans(spark: SparkSession, d: str) -> DataFrame:
    """The JSON that a whole text carries; none of these texts is JSON as a whole."""
    return read_table(spark, d, "documents").select("doc_id", reports.json_reply(F.col("text")).alias("reply"))


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _tidied(x: str) -> str:
    """SQL for the text of markup: entities as characters, white space of all kinds collapsed."""
    return f"trim(regexp_replace({_unescaped(x)}, '{_SPACE}', ' ', 'g'), ' ')"


def _unescaped(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(
    "SELECT body_id, " + _tidied(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title, " + _tidied(r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
    + r" AS h1, len(regexp_extract_all(html, '(?i)<table\b')) AS tables FROM page_bodies"
)
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    """Title, main heading and number of tables of each stored page."""
    return _parsed(spark, d).select("body_id", "parsed.title", "parsed.h1", F.size("parsed.tables").cast("bigint").alias("tables"))


@query(
    r"WITH r AS (SELECT body_id, unnest(regexp_extract_all(html, '(?is)<tr><t[hd]>(?:[^<]*)</t[hd]><t[hd]>(?:[^<]*)</t[hd]></tr>')) AS x FROM page_bodies) SELECT body_id, "
    + _tidied(r"regexp_extract(x, '(?is)<tr><t[hd]>([^<]*)</t[hd]>', 1)") + " AS label, " + _tidied(r"regexp_extract(x, '(?is)</t[hd]><t[hd]>([^<]*)</t[hd]></tr>', 1)") + " AS value, count(*) AS n FROM r GROUP BY ALL"
)
def page_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of two cells of every table of each stored page."""
    rows = _parsed(spark, d).select("body_id", F.explode("parsed.tables").alias("t")).select("body_id", F.explode("t.grid").alias("r")).where(F.size("r") == 2)
    return rows.groupBy("body_id", F.get("r", F.lit(0)).alias("label"), F.get("r", F.lit(1)).alias("value")).agg(F.count("*").alias("n"))


@query(
    r"WITH r AS (SELECT body_id, unnest(regexp_extract_all(html, '(?is)<a [^>]*href=\"[^\"#][^\"]*\"[^>]*>.*?</a>')) AS x FROM page_bodies) SELECT body_id, " + _tidied(r"regexp_replace(x, '<[^>]*>', '', 'g')")
    + r" AS text, count(*) AS n FROM r WHERE NOT regexp_matches(x, '(?i)href=\"(?:mailto|tel|javascript):') GROUP BY ALL"
)
def page_link_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every link of each stored page."""
    return _parsed(spark, d).select("body_id", F.explode("parsed.links").alias("l")).groupBy("body_id", F.col("l.text").alias("text")).agg(F.count("*").alias("n"))
