"""Structural signs of a page and the label that they give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import urls as U
from skarn.functions.text import order_numbers

# Headings of specifications (parts of a heading), of ordering, and whole headings of editorial pages.
SPEC_HEADINGS = [
    "technical data", "technical specifications", "specifications", "tech specs", "specification", "technische daten", "spezifikationen", "données techniques", "caractéristiques techniques", "spécifications",
    "datos técnicos", "especificaciones", "características técnicas", "dati tecnici", "specifiche tecniche", "dados técnicos", "especificações", "technische gegevens", "specificaties", "dane techniczne", "specyfikacja",
    "技术参数", "技术数据", "規格", "仕様",
]
ORDER_HEADINGS = ["order information", "ordering information", "ordering", "order data", "bestellinformationen", "bestelldaten", "informations de commande", "información de pedido", "informazioni per l'ordine", "bestelinformatie"]
EDITORIAL_HEADINGS = ["job description", "press release", "press releases", "webinar", "webinars", "publications", "newsletter"]


def _any_holds(headings: Column, terms: list[str]) -> Column:
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.exists(headings, lambda h: F.exists(wanted, lambda t: F.contains(F.lower(h), t)))


def page_signals(pages: DataFrame, url: str = "url", parsed: str = "parsed", spec_terms: list[str] | None = None, order_terms: list[str] | None = None) -> DataFrame:
    """Adds sig: depth, slug, title, h1, headings, table_count, has_product, has_spec, has_order, editorial, order_numbers, pdf_links, text_length.

    spec_terms and order_terms are added to the fixed ones.
    """
    p = F.col(parsed)
    return pages.withColumn(
        "sig",
        F.struct(
            U.depth(F.col(url)).alias("depth"), F.coalesce(U.slug(F.col(url)), F.lit("")).alias("slug"), p["title"].alias("title"), p["h1"].alias("h1"), p["headings"].alias("headings"), F.size(p["tables"]).alias("table_count"),
            p["has_product"].alias("has_product"), _any_holds(p["headings"], [*SPEC_HEADINGS, *(spec_terms or [])]).alias("has_spec"), _any_holds(p["headings"], [*ORDER_HEADINGS, *(order_terms or [])]).alias("has_order"),
            F.exists(p["headings"], lambda h: F.rtrim(F.lower(F.trim(h)), F.lit(":")).isin(*EDITORIAL_HEADINGS)).alias("editorial"), order_numbers(p["main_text"]).alias("order_numbers"), p["pdf_links"].alias("pdf_links"), p["text_length"].alias("text_length"),
        ),
    )


def score(spec: Column, order: Column, codes: Column, product: Column, pdfs: Column, depth_fits: Column, slug_fits: Column, editorial: Column, prior: Column, threshold: float = 0.6) -> Column:
    """struct<score, label>: weights added in this order as doubles and held to 0..1.

    instrument from the threshold up; other if no strong sign speaks for the page and the score is 0 or a heading is
    editorial; else unknown.
    """
    add = lambda s, c, w: s + F.when(c, F.lit(w)).otherwise(0.0)
    s = F.lit(0.0) + prior
    for c, w in ((spec, 0.45), (order, 0.2), (codes, 0.2), (product, 0.3), (pdfs, 0.1), (depth_fits, 0.15), (slug_fits, 0.15), (editorial, -0.5)):
        s = add(s, c, w)
    s = F.greatest(F.lit(0.0), F.least(s, F.lit(1.0)))
    strong = spec | order | codes | product | (prior > 0)
    return F.struct(s.alias("score"), F.when(s >= threshold, "instrument").when(~strong & ((s == 0) | editorial), "other").otherwise("unknown").alias("label"))


def digest(pages: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Adds digest: what a reader needs of a page, shortened: title, h1, headings, the first long paragraph's length."""
    p = F.col(parsed)
    return pages.withColumn(
        "digest",
        F.struct(F.substring(p["title"], 1, 160).alias("title"), F.substring(p["h1"], 1, 160).alias("h1"), F.transform(F.slice(p["headings"], 1, 8), lambda h: F.substring(h, 1, 60)).alias("headings"), F.substring(p["main_text"], 1, 400).alias("intro"), F.slice(order_numbers(p["main_text"]), 1, 3).alias("order_numbers")),
    )
