"""Problem 3: freely typed names mapped to the closest entry of a reference list, misses reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.naming import lexicon_of, lookup
from skarn.session import read_table, spread


def map_names(values: DataFrame, text: str, refs: DataFrame, ref_id: str, name: str, aliases: str) -> DataFrame:
    """Adds ref_id (-1: nothing in the list is meant), edits (weighted distance, null on a miss) and exact to values.

    The symmetric-delete index of the list, a fixed list whose size is checked, is broadcast; values aren't shuffled.
    Null and blank texts have ref_id null; exact is true where the text equals a list entry (not an alias) to the letter.
    Entries that are equally near rank by how often values names them exactly, then by the lower id. Very long texts are
    looked up whole. An empty table gives an empty result; repeated rows stay; columns with the names that this adds
    are replaced.
    """
    blank = F.col(text).isNull() | (F.trim(F.regexp_replace(F.col(text), r"[\s\x{00a0}\x{200b}\x{202f}]+", " ")) == "")
    exact = refs.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(ref_id).alias("__exact"))
    uses = values.groupBy(F.col(text).alias("__name")).count().join(F.broadcast(exact), "__name").select("__exact", "count")
    lexicon = lexicon_of(refs, ref_id, name, aliases, uses)
    rows = values.drop("ref_id", "edits", "exact").join(F.broadcast(exact), F.col(text) == F.col("__name"), "left").drop("__name")
    # Texts repeat: each is looked up once, and the answers, one row per text, are joined back.
    open_ = F.when(~blank & F.col("__exact").isNull(), F.col(text))
    rows = rows.withColumn("__text", open_)
    texts = spread(rows.where(F.col("__text").isNotNull()).select("__text").distinct())
    answers = texts.select(F.col("__text").alias("__key"), lookup(texts, F.col("__text"), lexicon).alias("__found"))
    found = rows.join(answers, F.col("__text") == F.col("__key"), "left").drop("__key", "__text")
    return found.withColumns(
        {
            "ref_id": F.coalesce("__exact", F.col("__found.ref_id")).cast("int"),
            "edits": F.when(F.col("__exact").isNotNull(), F.lit(0.0)).otherwise(F.when(F.col("__found.ref_id") >= 0, F.col("__found.distance"))),
            "exact": F.col("__exact").isNotNull(),
        }
    ).drop("__exact", "__found")


def _mapped(spark, sf_dir: str) -> DataFrame:
    """field, row_id, ord, text, ref_id, edits, exact of both lists' values that are neither null nor blank."""
    entries = read_table(spark, sf_dir, "scope_entries").select(F.col("entry_id").alias("row_id"), F.lit(0).alias("ord"), F.col("category").alias("text"))
    tables = read_table(spark, sf_dir, "spec_tables").select(F.col("table_id").alias("row_id"), F.posexplode("attributes").alias("ord", "text"))
    by_category = map_names(entries, "text", read_table(spark, sf_dir, "category_refs"), "category_id", "category", "aliases")
    by_attribute = map_names(tables.withColumn("ord", F.col("ord") + 1), "text", read_table(spark, sf_dir, "attribute_refs"), "attribute_id", "label", "aliases")
    columns = ["row_id", "ord", "text", "ref_id", "edits", "exact"]
    both = by_category.select(F.lit("category").alias("field"), *columns).unionByName(by_attribute.select(F.lit("attribute").alias("field"), *columns))
    return both.where(F.col("ref_id").isNotNull())


def p3_found(spark, sf_dir: str) -> DataFrame:
    """field, row_id, ord, ref_id of the values that aren't written exactly as in the list; ref_id -1 where nothing in it is meant."""
    return _mapped(spark, sf_dir).where(~F.col("exact")).select("field", "row_id", F.col("ord").cast("int").alias("ord"), "ref_id").distinct()


def p3_misses(spark, sf_dir: str) -> DataFrame:
    """The report of misses: field, text, uses of each text that no list entry is meant by."""
    return _mapped(spark, sf_dir).where(F.col("ref_id") == -1).groupBy("field", "text").agg(F.count("*").alias("uses"))
