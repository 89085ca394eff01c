"""Whole plans: pages to labelled pages, pages to records, records to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import urls as U
from skarn.functions.specvalue import spec_value
from skarn.functions.text import attribute_key, clean_variant, interfaces
from skarn.operators.grids import grid_records, is_no_spec_table, is_order_list, orientation, plausible_names
from skarn.operators.signals import SPEC_HEADINGS, page_signals, score
from skarn.session import cut
from skarn.sources.html import with_page

# Headings under which a table holds no specifications.
NO_SPEC_HEADING = r"(?i)\b(resources?|downloads?|literature|documents?|brochures?|publications?|citations?|references|webinars?|videos?|application notes?|accessor(?:y|ies)|consumables?|ordering|related|you may also|news|events?|faqs?|support)\b"


def labelled_pages(pages: DataFrame, body: str = "html", url: str = "url", prior: float = 0.0) -> DataFrame:
    """Adds parsed, sig and label to pages (url, body)."""
    p = page_signals(with_page(pages, body, url).drop(body), url)
    s = F.col("sig")
    label = score(s["has_spec"], s["has_order"], F.size(s["order_numbers"]) > 0, s["has_product"], s["pdf_links"] > 0, F.lit(False), F.lit(False), s["editorial"], F.lit(prior))
    return p.withColumn("label", label)


def best_tables(pages: DataFrame, key: str) -> DataFrame:
    """key, name, heading, grid, spec_heading: the specification table of each parsed page, if it has one.

    Tables under other headings, lists of downloads or orders, and tables too small or with over 12 entities are passed
    over; a specification heading wins, then more attributes, then the earlier table.
    """
    t = pages.select(key, F.col("parsed.h1").alias("name"), F.posexplode("parsed.tables").alias("ord", "t")).select(key, "name", "ord", F.col("t.heading").alias("heading"), F.col("t.grid").alias("grid"))
    terms = F.array(*[F.lit(h) for h in SPEC_HEADINGS])
    t = t.withColumn("spec_heading", F.exists(terms, lambda h: F.contains(F.lower("heading"), h)))
    rows, width = F.size("grid"), F.size(F.get("grid", F.lit(0)))
    least = F.when(F.col("spec_heading"), 2).otherwise(3)
    t = t.where((F.col("spec_heading") | ~F.col("heading").rlike(NO_SPEC_HEADING)) & (rows >= least) & (width >= 2))
    t = t.where(~is_no_spec_table(F.col("grid")) & ~is_order_list(F.col("grid")))
    across = orientation(F.col("grid"))["orientation"] == "attribute_major"
    t = t.withColumn("entities", F.when(across, width - 1).otherwise(rows - 1)).withColumn("attributes", F.when(across, rows - 1).otherwise(width - 1))
    t = t.where(F.col("entities").between(1, 12) & (F.col("attributes") >= F.when(F.col("spec_heading"), 1).otherwise(3)))
    best = F.max_by(F.struct("name", "heading", "grid", "spec_heading"), F.struct(F.col("spec_heading"), F.col("attributes"), -F.col("ord")))
    return t.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def page_records(pages: DataFrame, key: str) -> DataFrame:
    """key, ent_ord, entity, attribute, attribute_key, raw, spec: the parsed values of the best table of each page.

    A table whose entities don't look like devices is read along the other axis if that one does; if neither does, it
    describes one device, the page's, and its attributes are told apart by entity.
    """
    tables = best_tables(pages, key)
    head = lambda g: F.slice(F.get(g, F.lit(0)), 2, F.greatest(F.size(F.get(g, F.lit(0))) - 1, F.lit(0)))
    side = lambda g: F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")))
    # Written once: the signs of a grid are large expressions that what follows uses several times.
    tables = cut(tables.withColumns({"found": orientation(F.col("grid"))["orientation"], "across": plausible_names(head(F.col("grid")), F.col("name"), F.lit("")), "down": plausible_names(side(F.col("grid")), F.col("name"), F.lit(""))}))
    found, across, down = F.col("found"), F.col("across"), F.col("down")
    pair = ~across & ~down & (F.size(F.get("grid", F.lit(0))) == 2)  # labels and values of one device, without a header
    forced = F.when((found == "attribute_major") & ~across & down, "variant_major").when((found == "variant_major") & ~down & across | pair, "attribute_major").otherwise(found)
    several = F.when(found == "attribute_major", F.size(head(F.col("grid")))).otherwise(F.size(side(F.col("grid")))) > 1
    tables = tables.withColumn("forced", forced).withColumn("pair", pair).withColumn("flat", ~across & ~down & ~pair & several)
    tables = tables.withColumn("grid", F.when(F.col("pair"), F.concat(F.array(F.array(F.lit(""), F.col("name"))), F.col("grid"))).otherwise(F.col("grid")))
    cells = grid_records(tables.withColumn("__of", F.struct(key, "flat", F.col("name").alias("page_name"))), "__of", "grid", F.col("forced")).select("*", "__of.*").drop("__of")
    kept = cells.where((F.trim("attribute") != "") & (F.trim("value") != ""))
    kept = kept.withColumns({
        "attribute": F.when(F.col("flat"), F.format_string("%s (%s)", "attribute", "entity")).otherwise(F.col("attribute")),
        "entity": F.when(F.col("flat"), F.col("page_name")).otherwise(F.col("entity")), "ent_ord": F.when(F.col("flat"), F.lit(1)).otherwise(F.col("ent_ord")),
    })
    return kept.select(key, "ent_ord", clean_variant(F.col("entity")).alias("entity"), "attribute", attribute_key(F.col("attribute")).alias("attribute_key"), F.col("value").alias("raw"), spec_value(F.col("value")).alias("spec"), "section")


def eav(records: DataFrame) -> DataFrame:
    """product_id, manufacturer, device, attribute, kind, value, value_min, value_max, unit, raw, source_url: one row per attribute of specs."""
    rows = records.where(F.col("specs").isNotNull()).select("product_id", "listing_id", "manufacturer", F.col("name").alias("device"), F.col("url").alias("source_url"), F.explode("specs").alias("attribute", "raw"))
    return rows.withColumn("s", spec_value(F.col("raw"))).select("product_id", "listing_id", "manufacturer", "device", "attribute", "s.kind", "s.value", "s.value_min", "s.value_max", "s.unit", "s.raw", "source_url")


def wide(records: DataFrame) -> DataFrame:
    """The deliverable table: ten text columns; lists joined, specs as JSON."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c, n: F.coalesce(F.array_join(F.slice(c, 1, n), "; "), F.lit(""))
    return records.select(
        "listing_id", "product_id", text("manufacturer").alias("manufacturer"), text("name").alias("name"), text("category").alias("category"), text("url").alias("url"), listed("interfaces", 1000).alias("interfaces"),
        F.substring(text("description"), 1, 300).alias("description"), text("image_url").alias("image_url"), listed("datasheet_urls", 5).alias("datasheet_urls"), F.coalesce(F.to_json("specs"), F.lit("{}")).alias("specs"),
    )


def category_columns(records: DataFrame, category: str, coverage: float = 0.5) -> list[str]:
    """Attributes that enough records of a category have, sorted; one small aggregate."""
    members = records.where(F.col("category") == category)
    n = members.count()
    counts = members.where(F.col("specs").isNotNull()).select(F.explode(F.map_keys("specs")).alias("a")).groupBy("a").count()
    return sorted(r[0] for r in counts.where(F.col("count") >= max(1, int(n * coverage))).collect())


def pivot_category(records: DataFrame, category: str, coverage: float = 0.5) -> DataFrame:
    """listing_id, name, url and one text column per frequent attribute of the category; missing ones are empty."""
    columns = category_columns(records, category, coverage)
    return records.where(F.col("category") == category).select("listing_id", "name", "url", *[F.coalesce(F.try_element_at("specs", F.lit(c)), F.lit("")).alias(c) for c in columns])


def pivot_categories(records: DataFrame, coverage: float = 0.5) -> DataFrame:
    """listing_id, category, cells (map of attribute to text): every record with the frequent attributes of its category,
    in long form, since each category has its own columns. Records without a category belong to the empty one."""
    rows = records.withColumn("category", F.coalesce("category", F.lit("")))
    sizes = rows.groupBy("category").agg(F.count("*").alias("n"))
    counts = rows.where(F.col("specs").isNotNull()).select("category", F.explode(F.map_keys("specs")).alias("a")).groupBy("category", "a").agg(F.count("*").alias("k"))
    frequent = counts.join(sizes, "category").where(F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("n") * coverage)))
    columns = frequent.groupBy("category").agg(F.array_sort(F.collect_list("a")).alias("columns"))  # the columns of one table
    cell = lambda a: F.coalesce(F.try_element_at("specs", a), F.lit(""))
    return rows.join(columns, "category").select("listing_id", "category", F.map_from_arrays("columns", F.transform("columns", cell)).alias("cells"))


def scope_by_words(entries: DataFrame, text: str, url: str) -> DataFrame:
    """Adds in_scope: menu entries that look like products without a model's help: catalogue address, no editorial one."""
    return entries.withColumn("in_scope", (U.crawl_priority(F.col(url)) == 0) & ~U.is_editorial(F.col(url)) & ~F.coalesce(F.lower(F.col(text)).rlike(r"service|support|news|career|about|contact|software|training"), F.lit(False)))


def with_interfaces(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("interfaces", interfaces(F.col(text)))
