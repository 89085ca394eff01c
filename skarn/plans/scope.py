"""Which menu entries belong to the catalogue, by their own words and those above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import urls as U

# Menu words of products, of what is none, and of roots that are no category.
PRODUCT_WORDS = r"(?i)\b(products?|instruments?|equipment|systems|devices|hardware|portfolio|produkte|geräte|produits|productos|prodotti)\b"
OTHER_WORDS = (
    r"(?i)\b(consumables?|reagents?|kits?|supplies|software|services?|support|applications?|training|literature|downloads?|news|events?|careers?|about|investors?|contact|webinars?|blog|resources?|case stud(?:y|ies)|"
    r"industr(?:y|ies)|markets?|parts|accessories|tubes|plates|tips|labware|selector|calculator|request|quote)\b"
)
ROOT_WORDS = r"(?i)^(products?|instruments?|produkte|all products|shop)$"


def menu_scope(links: DataFrame) -> DataFrame:
    """site, url, text, role (product or hub), category of menu links (site, href, text, trail, region) that are in scope.

    A product word must be in the link or above it and no other word in either; links of footers are left out. Links
    whose text stands above others of the site are hubs. One row per site and page: the longest trail, then the least text.
    """
    entries = links.where((F.col("region") == "nav") & U.is_menu_link(F.col("href"), F.col("text"))).withColumn("key", U.page_key(F.col("href")))
    entries = entries.groupBy("site", "key").agg(F.min(F.struct(-F.size("trail"), F.col("text"), F.col("href"), F.col("trail"))).alias("e")).select("site", "e.text", "e.href", "e.trail")
    words = F.concat_ws(" ", F.array_join("trail", " "), "text")
    kept = entries.where(words.rlike(PRODUCT_WORDS) & ~words.rlike(OTHER_WORDS))
    parents = entries.select("site", F.explode("trail").alias("text")).distinct().withColumn("is_hub", F.lit(True))
    category = F.coalesce(F.try_element_at(F.filter("trail", lambda t: ~t.rlike(ROOT_WORDS)), F.lit(-1)), F.lit(""))
    both = kept.withColumn("category", category).join(parents, ["site", "text"], "left")
    return both.select("site", F.col("href").alias("url"), "text", F.when(F.col("is_hub"), "hub").otherwise("product").alias("role"), "category")


def affiliated_domains(links: DataFrame) -> DataFrame:
    """site, domain of the other registrable domains that a site's pages link to."""
    other = links.select("site", U.registrable_domain(U.part(F.col("href"), 2)).alias("domain"), U.registrable_domain(F.col("site")).alias("own"))
    return other.where((F.col("domain") != F.col("own")) & F.contains("domain", F.lit("."))).select("site", "domain").distinct()
