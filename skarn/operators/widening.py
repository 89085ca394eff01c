"""Problem 4: attribute-value rows to one typed row per entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import cells
from skarn.operators.naming import lexicon_of, lookup
from skarn.operators.quantities import READING, quantity_reading
from skarn.session import read_table, ship_package, spread

#: The Spark type of each value_type.
TYPES = {"quantity": "double", "integer": "bigint", "boolean": "boolean", "text": "string", "date": "date"}


@dataclass(frozen=True)
class Attribute:
    key: str
    value_type: str
    common_unit: str | None


def discover(attributes: DataFrame) -> list[Attribute]:
    """The fixed attribute list with its types, in order of attribute_id: the columns of the wide table."""
    rows = attributes.select("attribute_id", "attribute", "value_type", "common_unit").where(F.col("attribute").isNotNull()).orderBy("attribute_id").collect()
    return [Attribute(r[1], r[2], r[3]) for r in rows if r[2] in TYPES]


def typed(df: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """Adds __type and one column per value_type with the cell's typed value, null where it holds none of that type.

    df: key, raw, value, unit, label. raw decides when it isn't null, else value (with unit). Quantities are read once
    per batch and distinct text and come in the attribute's common unit.
    """
    ship_package(df.sparkSession)
    pairs = lambda pick: F.create_map(*[F.lit(x) for a in attributes for x in (a.key, pick(a))])
    df = df.withColumn("__type", pairs(lambda a: a.value_type)[F.col("key")]).where(F.col("__type").isNotNull())
    quantities = [a for a in attributes if a.common_unit]
    unit = F.create_map(*[F.lit(x) for a in quantities for x in (a.key, a.common_unit)])[F.col("key")] if quantities else F.lit(None).cast("string")
    as_text = F.coalesce(F.col("raw"), F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""))
    is_type = lambda t: F.col("__type") == t
    only = lambda t, c: F.when(is_type(t), c)
    # The reader sees a unit only for quantity rows; without one it would read any text.
    df = df.withColumn("__text", as_text).withColumn("__q", F.when(is_type("quantity") & (F.col("raw").isNull() | cells.holds_number(F.col("raw"))), unit))
    df = df.withColumn("__reading", F.pandas_udf(_read, READING)("__q", F.when(F.col("__q").isNotNull(), F.col("raw")), "value", "unit", "label"))
    return df.withColumns(
        {
            "__quantity": F.col("__reading.upper") * F.col("__reading.scale") + F.col("__reading.shift"),
            "__integer": only("integer", cells.whole_number(F.col("__text"))),
            "__boolean": only("boolean", cells.yes_or_no(F.col("__text"))),
            "__date": only("date", cells.day(F.col("__text"))),
            "__string": only("text", F.when(cells.is_real(F.col("__text")), cells.tidy(F.col("__text")))),
        }
    ).drop("__reading", "__q", "__text")


def _read(unit, raw, value, name, label):
    """quantity_reading for rows that have a common unit; the others are left empty."""
    got = quantity_reading(unit[unit.notna()], raw[unit.notna()], value[unit.notna()], name[unit.notna()], label[unit.notna()])
    got.index = unit.index[unit.notna()]
    return got.reindex(unit.index)


def widen(df: DataFrame, entity: list[str], attributes: list[Attribute], newest: list[Column]) -> DataFrame:
    """One row per entity with one typed column per attribute.

    df: the entity columns, key (an attribute's key; other keys give no cell), raw, value, unit, label and what newest
    needs. Of several rows that hold a value of the type, the one with the greatest newest wins; the order must be
    total for a defined result, ties of equal order take the greatest value. Entities with a null in any column are left
    out; an entity without any filled cell keeps a row of nulls. One aggregation by entity, combined before the shuffle.
    """
    df = spread(df)
    for name in entity:
        df = df.where(F.col(name).isNotNull())
    cells_ = typed(df, attributes)
    column = {"quantity": "__quantity", "integer": "__integer", "boolean": "__boolean", "text": "__string", "date": "__date"}
    aggregates = []
    for a in attributes:
        value = F.col(column[a.value_type])
        pick = F.struct(*newest, value.alias("v"))
        aggregates.append(F.max(F.when((F.col("key") == a.key) & value.isNotNull(), pick))["v"].cast(TYPES[a.value_type]).alias(a.key))
    return cells_.groupBy(*entity).agg(*aggregates)


def filled(wide: DataFrame, entity: list[str], attributes: list[Attribute]) -> DataFrame:
    """entity columns and attribute of every cell of a wide table that is filled."""
    keys = F.array_compact(F.array(*[F.when(F.col(a.key).isNotNull(), F.lit(a.key)) for a in attributes]))
    return wide.select(*entity, F.explode(keys).alias("attribute"))


def wide_records(spec_values: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per listing of spec_values; the newest filled row of an attribute wins, then the higher spec_id."""
    rows = spec_values.select("listing_id", F.col("attribute").alias("key"), "raw", "value", "unit", "label", "seen_at", "ingested_at", "spec_id")
    return widen(rows, ["listing_id"], attributes, [F.col("seen_at"), F.col("ingested_at"), F.col("spec_id")])


def wide_tables(spec_cells: DataFrame, refs: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per entity of each table of spec_cells; freely typed attributes are looked up; the lowest column and value win ties."""
    lexicon = lexicon_of(refs, "attribute_id", "label", "aliases")
    keys = F.create_map(*[F.lit(x) for r in refs.select("attribute_id", "attribute").collect() for x in (r[0], r[1])])
    none = lambda t: F.lit(None).cast(t)
    rows = spread(spec_cells).select(
        "table_id", "ent_ord", keys[lookup(spec_cells, F.col("attribute"), lexicon)["ref_id"]].alias("key"),
        F.col("value").alias("raw"), none("double").alias("value"), none("string").alias("unit"), F.col("attribute").alias("label"), "attr_ord",
    )
    return widen(rows, ["table_id", "ent_ord"], attributes, [-F.col("attr_ord"), F.col("raw")])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """src, row_id, ord, attribute: the filled cells of both wide tables."""
    refs = read_table(spark, sf_dir, "attribute_refs")
    attributes = discover(refs)
    records = filled(wide_records(read_table(spark, sf_dir, "spec_values"), attributes), ["listing_id"], attributes)
    tables = filled(wide_tables(read_table(spark, sf_dir, "spec_cells"), refs, attributes), ["table_id", "ent_ord"], attributes)
    return records.select(F.lit("record").alias("src"), F.col("listing_id").alias("row_id"), F.lit(0).alias("ord"), "attribute").unionByName(
        tables.select(F.lit("table").alias("src"), F.col("table_id").alias("row_id"), F.col("ent_ord").alias("ord"), "attribute")
    )
