"""Tables as grids (array of rows of cells): which axis names the attributes, records, and tables that hold no specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import DATE_START, common_prefix, let

# Header words that settle that a table is no specification table, and words that only hint at it.
STRONG = [
    "language", "sprache", "langue", "idioma", "lingua", "download", "downloads", "brochure", "brochures", "flyer", "filesize", "cookie", "consent",
    "provider", "expiry",
]
WEAK = [
    "info", "size", "format", "status", "file", "datasheet", "required", "included", "optional", "accessory", "accessories", "price", "preis", "prix",
    "precio", "availability", "stock", "description", "title", "order",
]
LANGUAGE = r"(?i)^(?:de|en|fr|es|it|nl|pt|pl|cs|ru|zh|ja|ko)$"
FILE_SIZE = r"(?i)^\s*(?:pdf|docx?|xlsx?|zip)[, ]+.*\d+\s*[kmg]b\s*$"
ORDER_CELL = r"(?i)^\s*(?=[A-Z0-9]*\d)[A-Z0-9]{2,}[-./][A-Z0-9]{2,}[-./][A-Z0-9]{1,}\s*$"
# Rows that name the variants, in order of preference.
NAMING_ROWS = ["designation", "model", "type", "product", "name", "variant", "order number", "article number"]


def transposed(grid: Column) -> Column:
    """Rows as columns; the grid must be rectangular."""
    width = F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))
    return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(grid, lambda row: F.get(row, i)))


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def _share_with_digit(cells: Column) -> Column:
    kept = F.filter(cells, lambda c: c != "")
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.size(F.filter(kept, lambda c: c.rlike(r"\d"))) / F.size(kept))


def _shared_start(cells: Column) -> Column:
    kept = F.filter(cells, lambda c: c != "")

    def share(k: Column) -> Column:
        n = F.length(F.trim(common_prefix(F.array_min(k), F.array_max(k))))
        letters = F.aggregate(k, F.lit(0), lambda a, c: a + F.length(c))
        return F.when((F.size(k) < 2) | (n < 3), 0.0).otherwise(n / (letters / F.size(k)))

    return let(kept, share)


def _mean_length(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.greatest(F.size(cells), F.lit(1))


def orientation(grid: Column) -> Column:
    """struct<orientation, confidence>: variant_major if the first row names attributes, else attribute_major.

    Two structures decide at once: a first row without labels, and two or more rows that hold only a label. Else signs
    are added up: an empty corner, which axis shares a common start, has fewer digits, has shorter cells.
    """

    def judge(parts: Column) -> Column:
        row, col = parts["row"], parts["col"]

        def scored(m: Column) -> Column:
            s = F.when(_blank(m["corner"]), 0.15).otherwise(0.0)
            s = s + F.when(m["cp"] > m["rp"] + 0.15, 0.45).when(m["rp"] > m["cp"] + 0.15, -0.45).otherwise(0.0)
            s = s + F.when(m["rd"] + 0.15 < m["cd"], 0.25).when(m["cd"] + 0.15 < m["rd"], -0.25).otherwise(0.0)
            s = s + F.when(m["rl"] + 10 < m["cl"], 0.2).when(m["cl"] + 10 < m["rl"], -0.2).otherwise(0.0)
            return let(s, lambda x: F.struct(F.when(x > 0, "variant_major").otherwise("attribute_major").alias("orientation"), F.least(F.abs(x), F.lit(1.0)).alias("confidence")))

        fixed = lambda c: F.struct(F.lit("attribute_major").alias("orientation"), F.lit(c).alias("confidence"))
        measures = F.struct(
            parts["corner"].alias("corner"), _shared_start(row).alias("rp"), _shared_start(col).alias("cp"), _share_with_digit(row).alias("rd"), _share_with_digit(col).alias("cd"), _mean_length(row).alias("rl"), _mean_length(col).alias("cl")
        )
        return F.when(parts["small"], fixed(0.0)).when(F.forall(row, _blank), fixed(0.9)).when(parts["sections"] >= 2, fixed(0.85)).otherwise(let(measures, scored))

    first = F.get(grid, F.lit(0))
    rest = F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))
    tail = lambda row: F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
    parts = F.struct(
        F.coalesce(F.get(first, F.lit(0)), F.lit("")).alias("corner"),
        F.coalesce(tail(first), F.array().cast("array<string>")).alias("row"),
        F.transform(rest, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))).alias("col"),
        ((F.size(grid) < 2) | (F.coalesce(F.size(first), F.lit(0)) < 2)).alias("small"),
        F.size(F.filter(rest, lambda r: ~_blank(F.get(r, F.lit(0))) & F.forall(tail(r), _blank))).alias("sections"),
    )
    return let(parts, judge)


def grid_records(df: DataFrame, key: str, grid: str, forced: Column | None = None) -> DataFrame:
    """key, ent_ord, entity, attr_ord, attribute, value, section: one row per cell of each grid.

    forced: an orientation to use instead of the detected one. Variant-major grids are turned first. Rows that hold only
    a label open a section; rows without a label are left out. Entities without a name take it from the first naming
    row, else column_N. Null and empty grids give no row.
    """
    base = df.select(F.col(key), F.col(grid).alias("g"), (forced if forced is not None else F.lit(None).cast("string")).alias("forced")).where(F.size("g") >= 2)
    base = base.withColumn("kind", F.coalesce("forced", orientation(F.col("g"))["orientation"])).drop("forced")
    base = base.withColumn("t", F.when(F.col("kind") == "variant_major", transposed(F.col("g"))).otherwise(F.col("g")))
    rows = base.select(key, "kind", F.get("t", F.lit(0)).alias("head"), F.posexplode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("row_ord", "r"))
    label = F.trim(F.get("r", F.lit(0)))
    values = F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))
    rows = rows.select(key, "kind", "head", "row_ord", label.alias("attribute"), values.alias("cells"))
    by_table = Window.partitionBy(key).orderBy("row_ord")
    is_section = (F.col("attribute") != "") & F.forall("cells", _blank) & (F.col("kind") == "attribute_major")
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(is_section, F.col("attribute")), ignorenulls=True).over(by_table), F.lit("")))
    rows = rows.where(~is_section & (F.col("attribute") != ""))
    rank = F.array_position(F.array(*[F.lit(n) for n in NAMING_ROWS]), F.lower("attribute"))
    naming = F.when((rank > 0) & ~F.forall("cells", _blank), F.struct(rank.alias("k"), F.col("row_ord"), F.col("cells")))
    rows = rows.withColumn("naming", F.min(naming).over(Window.partitionBy(key))).withColumn("attr_ord", F.row_number().over(by_table))
    out = rows.select(key, "head", "naming", "attr_ord", "attribute", "section", F.posexplode("cells").alias("i", "value"))
    given = F.slice("head", 2, F.greatest(F.size("head") - 1, F.lit(0)))
    named = F.when(~F.forall(given, _blank), F.get("head", F.col("i") + 1)).when(F.col("naming").isNotNull(), F.get("naming.cells", F.col("i"))).otherwise(F.concat(F.lit("column_"), F.col("i") + 1))
    return out.select(key, (F.col("i") + 1).alias("ent_ord"), named.alias("entity"), "attr_ord", "attribute", "value", "section")


def cells_to_grids(cells: DataFrame, key: str) -> DataFrame:
    """key, grid of tables whose cells lie in long form (ent_ord, entity, attr_ord, attribute, value): attributes down, entities across.

    A cell that is there several times counts once (the greatest value). One table is one group: tables are bounded.
    """
    once = cells.groupBy(key, "attr_ord", "ent_ord").agg(F.max("attribute").alias("attribute"), F.max("entity").alias("entity"), F.max(F.coalesce("value", F.lit(""))).alias("value"))
    rows = once.groupBy(key, "attr_ord").agg(F.max("attribute").alias("attribute"), F.array_sort(F.collect_list(F.struct("ent_ord", "entity", "value"))).alias("c"))
    tables = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attr_ord", "attribute", "c"))).alias("r"), F.max_by("c", F.size("c")).alias("widest"))
    head = F.concat(F.array(F.lit("")), F.transform("widest", lambda c: F.coalesce(c["entity"], F.lit(""))))
    line = lambda r: F.concat(F.array(F.coalesce(r["attribute"], F.lit(""))), F.transform(F.col("widest"), lambda w: F.coalesce(F.get(F.filter(r["c"], lambda c: c["ent_ord"] == w["ent_ord"]), F.lit(0))["value"], F.lit(""))))
    return tables.select(key, F.concat(F.array(head), F.transform("r", line)).alias("grid"))


def _words(row: Column) -> Column:
    return F.filter(F.flatten(F.transform(row, lambda c: F.split(F.lower(F.trim(c)), "[^a-zä-ÿ]+"))), lambda w: w != "")


def is_no_spec_table(grid: Column) -> Column:
    """True for lists of downloads, orders or cookies: by header words, a column of language codes or of file sizes."""
    head = F.array_distinct(_words(F.get(grid, F.lit(0))))
    weak = F.size(F.array_intersect(head, F.array(*[F.lit(w) for w in WEAK])))

    def column_is(pattern: str):
        def test(col: Column) -> Column:
            kept = F.filter(F.slice(col, 2, F.greatest(F.size(col) - 1, F.lit(0))), lambda c: ~_blank(c))
            return (F.size(kept) >= 2) & (F.size(F.filter(kept, lambda c: F.trim(c).rlike(pattern))) >= F.size(kept) * 0.6)

        return test

    columns = transposed(grid)
    return F.arrays_overlap(head, F.array(*[F.lit(w) for w in STRONG])) | ((F.size(F.get(grid, F.lit(0))) <= 4) & (weak >= 2)) | F.exists(columns, column_is(LANGUAGE)) | F.exists(columns, column_is(FILE_SIZE))


def is_order_list(grid: Column) -> Column:
    """True if half of the first or second column, two cells at least, are order codes and no dates."""

    def test(col: Column) -> Column:
        kept = F.filter(F.slice(col, 2, F.greatest(F.size(col) - 1, F.lit(0))), lambda c: ~_blank(c))
        hits = F.size(F.filter(kept, lambda c: c.rlike(ORDER_CELL) & ~F.trim(c).rlike(DATE_START)))
        return (F.size(kept) > 0) & (hits >= F.greatest(F.lit(2.0), F.size(kept) * 0.5))

    return F.exists(F.slice(transposed(grid), 1, 2), test)


def plausible_names(names: Column, page: Column, hint: Column) -> Column:
    """True if at least half of a table's entities look like devices: they share a word with the page's name or hint, or
    have letters and digits and are no quantity."""
    from skarn.functions.text import tokens

    family = F.array_union(tokens(page), tokens(hint))
    glued = F.regexp_replace(F.lower(F.concat_ws(" ", page, hint)), "[^a-z0-9]", "")
    quantity = r"^[<>≤≥~±]?\s*\d+(?:[.,]\d+)?\s*(?:[-–]\s*\d+(?:[.,]\d+)?\s*)?(?:[µμu]?[lL]|m[lL]|nl|mm|cm|m|µm|nm|kg|g|mg|V|kV|Hz|kHz|W|kW|A|rpm|x\s*g|°C|%|bar|psi|min|s|h|well|wells|plates?|samples?|tubes?|channels?)\.?$"
    kept = F.filter(names, lambda n: ~_blank(n))

    def good(n: Column) -> Column:
        words = tokens(n)
        shares = F.arrays_overlap(words, family) | F.exists(words, lambda w: (F.length(w) >= 4) & F.contains(glued, w))
        code = n.rlike("[A-Za-z]") & n.rlike(r"\d") & (F.length(n) <= 100) & ~F.trim(n).rlike("(?i)" + quantity)
        return ~F.trim(n).rlike(r"^column_\d+$") & (F.coalesce(shares, F.lit(False)) | code)

    return (F.size(kept) > 0) & (F.size(F.filter(kept, good)) >= F.greatest(F.lit(1), F.floor((F.size(kept) + 1) / 2)))
