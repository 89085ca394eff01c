"""What a user reads of a catalogue: site manifests, extraction summaries, device tables, choices of documents and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.functions import urls as U

# Words of device names that tell nothing; from how many pages, and what share of them, a document is a site's furniture.
NAME_STOP = ["the", "and", "for", "system", "series"]
LEAST_PAGES, LEAST_SHARE = 3, 0.2


def has_specs(specs: Column) -> Column:
    """Whether a record is a device row: it has a specification."""
    return F.coalesce(F.size(specs), F.lit(0)) > 0


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each key in the given total order. Keys are first cut down by salt, so a hot one is never sorted in one task."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(*order))).where(F.col("__n") <= k)
    return first.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= k).drop("__n", "__salt")


def url_tree(urls: DataFrame, url: str, hosts: int = 3, branches: int = 70, least: int = 3) -> DataFrame:
    """kind (host or branch), name, count: the largest hosts and the largest path prefixes of up to three segments."""
    by_host = urls.groupBy(U.host(F.col(url)).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(hosts)
    seg = U.segments(F.col(url))
    prefix = F.transform(F.sequence(F.lit(1), F.least(F.size(seg), F.lit(3))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(seg, F.lit(1), i), "/")))
    by_branch = urls.where(F.size(seg) > 0).select(F.explode(prefix).alias("name")).groupBy("name").agg(F.count("*").alias("count")).where(F.col("count") >= least).orderBy(F.desc("count"), "name").limit(branches)
    return by_host.select(F.lit("host").alias("kind"), "name", "count").unionByName(by_branch.select(F.lit("branch").alias("kind"), "name", "count"))


def site_furniture(records: DataFrame, site: str, page: str, documents: str) -> DataFrame:
    """site, document linked from so many pages of a site that it describes none of them."""
    pages = records.groupBy(site).agg(F.countDistinct(page).alias("pages"))
    linked = records.select(site, page, F.explode(documents).alias("document")).distinct().groupBy(site, "document").agg(F.count("*").alias("n"))
    return linked.join(pages, site).where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("pages") * LEAST_SHARE)).select(site, "document")


def choose_datasheet(records: DataFrame, key: str, site: str, page: str, name: str, documents: str) -> DataFrame:
    """key, document, score: each record's data sheet.

    Furniture of the site and documents whose name says they are something else are left out. The score of the file name,
    1 for a document of the site's own domain and 2 for each word that its path shares with the device's name, 4 at most,
    are added up; the best wins, the earlier on a tie, if it scores 1 or is the only candidate.
    """
    each = records.select(key, site, name, F.posexplode(documents).alias("ord", "document"))
    each = each.join(site_furniture(records, site, page, documents), [site, "document"], "left_anti").withColumn("base", T.sheet_score(F.col("document"), F.lit(""))).where(F.col("base") >= 0)
    own = U.registrable_domain(U.part(F.col("document"), 2)) == U.registrable_domain(F.lower(F.col(site)))
    shared = F.size(F.array_intersect(F.array_except(T.tokens(F.coalesce(F.col(name), F.lit(""))), F.array(*[F.lit(w) for w in NAME_STOP])), T.tokens(U.path(F.col("document")))))
    scored = each.withColumn("score", F.col("base") + F.coalesce(own, F.lit(False)).cast("int") + F.least(F.lit(4), shared * 2))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("ord")).alias("first"), "document")).alias("m"), F.count("*").alias("n"))
    return best.where((F.col("m.score") >= 1) | (F.col("n") == 1)).select(key, "m.document", "m.score")


def scan_manifest(fetches: DataFrame, bodies: DataFrame, scope: DataFrame, site: str = "vendor") -> DataFrame:
    """One row per site: addresses, fetches by outcome and source, bodies, redirects, and what its scope names."""
    f = fetches.join(bodies.select("body_path", F.lit(1).alias("stored")), "body_path", "left")
    per_site = f.groupBy(site).agg(
        F.count("*").alias("fetches"), F.countDistinct("url").alias("urls"), F.countDistinct("final_url").alias("pages"), F.count("stored").alias("stored"), F.count_if(F.col("body_path").isNotNull() & F.col("stored").isNull()).alias("lost"),
        F.count_if(F.col("source") == "archive").alias("from_archive"), F.count_if(F.col("source") == "blocked").alias("blocked"), F.count_if(F.col("status") >= 400).alias("refused"), F.count_if(F.col("url") != F.col("final_url")).alias("redirected"),
        F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at"),
    )
    named = scope.groupBy(site).agg(F.count_if(F.col("role") == "product").alias("products_named"), F.count_if(F.col("role") == "hub").alias("hubs_named"), F.countDistinct("url").alias("scope_urls"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per_site.join(named, site, "left").select(*per_site.columns, zero("products_named"), zero("hubs_named"), zero("scope_urls"))


def extract_summary(records: DataFrame, site: str = "vendor") -> DataFrame:
    """One row per site: records, pages, devices with specifications, distinct attributes, merged groups, devices with interfaces, categories."""
    numbers = records.groupBy(site).agg(
        F.count("*").alias("records"), F.countDistinct("url").alias("pages"), F.count_if(has_specs(F.col("specs"))).alias("with_specs"), F.count_if(F.size("source_variants") > 1).alias("merged_groups"), F.count_if(F.size("interfaces") > 0).alias("with_interfaces"),
    )
    keys = records.where(has_specs(F.col("specs"))).select(site, F.explode(F.map_keys("specs")).alias("a")).distinct().groupBy(site).agg(F.count("*").alias("attributes"))
    return numbers.join(keys, site, "left").select(*numbers.columns, F.coalesce("attributes", F.lit(0)).alias("attributes"))


def escalation(labelled: DataFrame, group: str, label: str = "label") -> DataFrame:
    """group, items, unknown, rate: the share of items whose label is still open."""
    out = labelled.groupBy(group).agg(F.count("*").alias("items"), F.count_if(F.col(label) == "unknown").alias("unknown"))
    return out.withColumn("rate", F.round(F.col("unknown") / F.greatest(F.col("items"), F.lit(1)), 6))


def category_lists(records: DataFrame, group: str, category: str) -> DataFrame:
    """group, categories: the distinct categories, sorted; blank ones are left out."""
    distinct = records.where(F.trim(category) != "").select(group, category).distinct()
    return distinct.groupBy(group).agg(F.array_sort(F.collect_list(category)).alias("categories"))


def running_usage(calls: DataFrame, user: str, at: str, amount: str) -> DataFrame:
    """user, day, calls and amount so far: sums per day, then running sums over a user's days."""
    daily = calls.groupBy(user, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.sum(amount).alias("a"))
    so_far = Window.partitionBy(user).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(user, "day", F.sum("n").over(so_far).alias("calls"), F.round(F.sum("a").over(so_far), 4).alias("amount"))


def device_table(records: DataFrame, category: str | None = None, limit: int | None = None, include_specs: bool = False) -> DataFrame:
    """The device table as it is read: openings of descriptions, two documents, and the specifications or their number."""
    if category is not None:
        records = records.where(F.lower("category") == category.lower())
    if limit is not None:
        records = records.orderBy("listing_id").limit(limit)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    specs = F.coalesce(F.to_json("specs"), F.lit("{}")) if include_specs else F.concat(F.coalesce(F.size("specs"), F.lit(0)).cast("string"), F.lit(" keys"))
    return records.select("listing_id", text("name"), text("category"), F.substring(F.coalesce("description", F.lit("")), 1, 160).alias("description"), F.coalesce(F.array_join(F.slice("datasheet_urls", 1, 2), "; "), F.lit("")).alias("datasheets"), specs.alias("specs"))


def specs_by_name(records: DataFrame, name: str, order: str) -> DataFrame:
    """key (the name in lower case), order and specs of the first record of each name; asking for a name is a filter on key."""
    key = F.lower(F.trim(F.col(name)))
    return records.where(key != "").groupBy(key.alias("key")).agg(F.min_by(F.struct(order, "specs"), order).alias("m")).select("key", f"m.{order}", "m.specs")


def in_order_of(extracted: DataFrame, listed: DataFrame, key: str, order: str, first: str) -> DataFrame:
    """Extracted rows in the order of a list: the first row of each key, joined to the key's first place; keys on one side only are left out."""
    places = listed.groupBy(key).agg(F.min(order).alias("place"))
    rows = extracted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(first).alias(first))
    return places.join(rows, key)


def accepted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is accepted."""
    return rows.join(ids.select(key), key, "left_semi")


def names_apart(records: DataFrame, page: str, name: str, order: str) -> DataFrame:
    """Adds device: the cleaned name; where that is the same for several records of a page, the name as it stands; where it is empty, the page and the record's place on it."""
    clean = T.clean_variant(F.col(name))
    on_page = Window.partitionBy(page)
    out = records.withColumn("__clean", F.coalesce(clean, F.lit("")))
    out = out.withColumn("__same", F.count("*").over(Window.partitionBy(page, "__clean"))).withColumn("__place", F.row_number().over(on_page.orderBy(order)))
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\s+", " "))
    named = F.when((F.col("__same") > 1) & (plain != ""), plain).otherwise(F.col("__clean"))
    return out.withColumn("device", F.when(named == "", F.format_string("%s variant %d", F.col(page), F.col("__place"))).otherwise(named)).drop("__clean", "__same", "__place")


def flattened(cells: DataFrame, key: str) -> DataFrame:
    """key, attribute, value: a table whose axis names no devices as one device, its attributes told apart by entity."""
    filled = cells.where((F.trim("attribute") != "") & (F.trim("value") != ""))
    return filled.groupBy(key, F.concat(F.trim("attribute"), F.lit(" ("), F.coalesce("entity", F.lit("")), F.lit(")")).alias("attribute")).agg(F.max("value").alias("value"))


def union_of_scopes(entries: DataFrame, site: str = "vendor") -> DataFrame:
    """site, url, role, decided_by: products and hubs of several decisions as one, each address once.

    Products come before hubs, then the menu's order. A decision is the model's if any of its parts is.
    """
    rank = F.struct(F.when(F.col("role") == "product", 0).otherwise(1).alias("r"), F.col("ord"), F.col("entry_id"), F.col("role"))
    once = entries.groupBy(site, "url").agg(F.min(rank).alias("m"))
    who = entries.groupBy(site).agg(F.max(F.when(F.col("decided_by") == "model", "model")).alias("m"), F.min("decided_by").alias("d"))
    return once.join(who.select(site, F.coalesce("m", "d").alias("decided_by")), site).select(site, "url", "m.role", "decided_by")


def seeds(*sources: tuple[str, DataFrame]) -> DataFrame:
    """key, url, via: addresses of several sources (name, frame with url), each page once; the first source wins, then the least address."""
    ranked = [df.select(F.lit(i).alias("rank"), "url", F.lit(name).alias("via")) for i, (name, df) in enumerate(sources)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    return every.groupBy(U.page_key(F.col("url")).alias("key")).agg(F.min(F.struct("rank", "url", "via")).alias("m")).select("key", "m.url", "m.via")


def remembered(links: DataFrame, url: str, by_url: DataFrame, by_branch: DataFrame) -> DataFrame:
    """Adds keep and by: the decision recorded for a link's address (by_url: url, keep), else for the path above it
    (by_branch: branch, keep); null where none is, which is what remains to be asked."""
    seg = U.segments(F.col(url))
    branch = F.concat(F.lit("/"), F.array_join(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), "/"))
    out = links.withColumn("__branch", branch).join(by_url.select(F.col("url").alias(url), F.col("keep").alias("__u")), url, "left").join(by_branch.select(F.col("branch").alias("__branch"), F.col("keep").alias("__b")), "__branch", "left")
    return out.withColumn("keep", F.coalesce("__u", "__b")).withColumn("by", F.when(F.col("__u").isNotNull(), "url").when(F.col("__b").isNotNull(), "branch")).drop("__u", "__b", "__branch")


def walk_sitemaps(sitemaps: DataFrame, site: str, order: list[Column], size: str, most: int = 50, most_urls: int = 50_000) -> DataFrame:
    """Sitemaps of each site that a walk in the given order reads: most of them, and none once most_urls were found.

    The bound on addresses is tested after a whole sitemap is added, so the last one may overstep it. Adds place and found.
    """
    by_order = Window.partitionBy(site).orderBy(*order)
    out = sitemaps.withColumn("place", F.row_number().over(by_order)).withColumn("found", F.sum(size).over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("place") <= most) & (F.col("found") - F.col(size) < most_urls))


def filled_fields(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fields: the names of the fields that a record's dictionary keeps; nulls, blank texts and empty lists are dropped."""
    kinds = {f.name: f.dataType.typeName() for f in records.schema}
    real = lambda c: (F.size(c) > 0) if kinds[c] in ("array", "map") else (F.col(c) != "") if kinds[c] == "string" else F.col(c).isNotNull()
    return records.select(key, F.array_compact(F.array(*[F.when(F.coalesce(real(c), F.lit(False)), F.lit(c)) for c in fields])).alias("fields"))


def json_reply(text: Column) -> Column:
    """The JSON of a reply: without the fences of a code block; else from the first brace to the last, else from the first bracket to the last; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```\w*\s*$", ""), r"^\s+|\s+$", "")
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.coalesce(whole, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")))
