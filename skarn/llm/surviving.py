"""Problem 6: the best value of each field of a group of duplicate records, by iterative truth discovery.

Every record claims one value per field. A source is a kind of record (spec_source) at an age: its claims that are the
newest of their group and field, and its older ones. A value's support is the sum of its sources' weights, and a source's
weight follows from its reliability, the share of its votes that go to the values with most support. Both are estimated
alternately until the reliabilities stand still. At first newer and older claims weigh alike and only the trust in the
kinds of sources differs; that newer claims are more reliable is learned.

No group is ever collected: records are first reduced to one row per (group, field, value), and every round is one
aggregation over those rows that is combined before its shuffle, so that a group holding a third of all rows spreads
over all tasks. Fields on which a group agrees need no rounds. Only the reliabilities come to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.cells import is_real
from skarn.session import cut, read_table

FIELDS = ["category", "description", "image_url", "source_variants", "regional_variants", "merge_reason"]
#: Kinds of sources are few and fixed; more than this is an error.
MOST_SOURCES = 256
#: Votes that the prior of a reliability counts as.
PRIOR_VOTES = 2.0


def _claim(df: DataFrame, field: str) -> tuple[Column, Column, Column]:
    """(the value as a key, whether it is a real value, how complete it is)."""
    kind = df.schema[field].dataType.typeName()
    col = F.col(field)
    if kind == "string":
        return col, is_real(col), F.length(F.trim(col))
    if kind in ("array", "map"):
        return F.to_json(col), F.coalesce(F.size(col) > 0, F.lit(False)), F.size(col)
    return col.cast("string"), col.isNotNull(), F.lit(1)


def value_rows(records: DataFrame, group: str, record_id: str, source: str, at: str, fields: list[str], kinds: list[str]) -> DataFrame:
    """group, field, value (its digest), newest, lowest (record id), complete, records, and t0, t1 ...: when each kind of source last claimed it.

    The last kind stands for all that are not named. One more row per group has a null field; its records are the
    group's rows.
    """
    marker = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("real"), F.lit(0).alias("size"))
    claims = F.array(marker, *[F.struct(F.lit(f).alias("field"), F.md5(v).alias("value"), F.coalesce(real, F.lit(False)).alias("real"), size.cast("int").alias("size")) for f in fields for v, real, size in [_claim(records, f)]])
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(source)), F.lit(0)) - 1
    kind = F.when(kind < 0, F.lit(len(kinds))).otherwise(kind)
    long = records.where(F.col(group).isNotNull()).select(group, record_id, kind.alias("__kind"), F.col(at).alias("__at"), F.explode(F.filter(claims, lambda c: c["real"])).alias("__c"))
    return long.groupBy(group, F.col("__c.field").alias("field"), F.col("__c.value").alias("value")).agg(
        F.max("__at").alias("newest"), F.min(record_id).alias("lowest"), F.max("__c.size").alias("complete"), F.count("*").alias("records"),
        *[F.max(F.when((F.col("__kind") == i) & F.col("__c.field").isNotNull(), F.coalesce("__at", F.lit(_NEVER).cast("timestamp")))).alias(f"t{i}") for i in range(len(kinds) + 1)],
    )


_NEVER = "0001-01-01 00:00:00"


def discover_truth(
    records: DataFrame, trust: dict[str, float], group: str = "product_id", record_id: str = "listing_id", source: str = "spec_source", at: str = "scraped_at",
    fields: list[str] = FIELDS, rounds: int = 20, tolerance: float = 1e-4, least_rows: int = 1,
) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """(group, field, value digest, record_id of the lowest record holding the surviving value; reliability by (kind, age)).

    The value with most support survives. A kind's older claims share one vote in each group and field, however many they
    are, so repeated scrapes of an old state don't add up; each of its newest claims is a vote. Equal support is decided
    by completeness, then the lower record id. trust: the fixed list of kinds of sources with their prior trust, higher is
    better; all other kinds, and null, are one kind with the least. Nulls, blanks, empty lists and stand-ins are no values;
    a field without a value in any record of the group gives no row; records with a null group give none, and groups of
    fewer than least_rows records give none. A null time is older than any other. Equal records add nothing. An empty
    table gives an empty result. Other columns are ignored.
    """
    if len(trust) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} kinds of sources: name coarser ones")
    kinds = sorted(trust)
    names = [*kinds, ""]
    every = cut(value_rows(records, group, record_id, source, at, fields, kinds))
    n = range(len(names))
    claims = every.where(F.col("field").isNotNull())
    facts = claims.groupBy(group, "field").agg(F.max(F.coalesce("newest", F.lit(_NEVER).cast("timestamp"))).alias("top"), F.count("*").alias("values"), *[F.count(f"t{i}").alias(f"k{i}") for i in n], *[F.max(f"t{i}").alias(f"m{i}") for i in n])
    if least_rows > 1:
        facts = facts.join(every.where(F.col("field").isNull() & (F.col("records") >= least_rows)).select(group), group, "left_semi")
    rows = claims.join(facts, [group, "field"])
    fresh = [F.coalesce((F.col(f"t{i}") == F.col("top")).cast("double"), F.lit(0.0)).alias(f"new{i}") for i in n]
    others = lambda i: F.greatest(F.lit(1), F.col(f"k{i}") - F.coalesce((F.col(f"m{i}") == F.col("top")).cast("int"), F.lit(0)))
    older = [F.when(F.col(f"t{i}") < F.col("top"), 1.0 / others(i)).otherwise(0.0).alias(f"old{i}") for i in n]
    votes = [f"{age}{i}" for age in ("new", "old") for i in n]
    rows = cut(rows.select(group, "field", "value", "lowest", "complete", "values", *fresh, *older))
    sums = [F.sum(v).alias(v) for v in votes]
    total = rows.agg(*sums).first()
    agreed = rows.where(F.col("values") == 1).agg(*sums).first()
    highest = max(trust.values(), default=0.0)
    prior = {v: (trust.get(names[int(v[3:])], 0.0) + 1.0) / (highest + 2.0) for v in votes}
    reliability = dict(prior)
    disputed = rows.where(F.col("values") > 1)

    def chosen(of: DataFrame) -> DataFrame:
        weight = {v: -math.log(max(1.0 - r, 1e-12)) for v, r in reliability.items()}
        support = reduce(lambda a, b: a + b, [F.col(v) * F.lit(weight[v]) for v in votes])
        best = F.max(F.struct(F.round(support, 9).alias("support"), F.col("complete"), (-F.col("lowest")).alias("low"), F.col("value"), *votes)).alias("best")
        return of.groupBy(group, "field").agg(best)

    for _ in range(rounds):
        agree = chosen(disputed).agg(*[F.sum(f"best.{v}").alias(v) for v in votes]).first()
        new = {v: ((agree[v] or 0.0) + (agreed[v] or 0.0) + prior[v] * PRIOR_VOTES) / ((total[v] or 0.0) + PRIOR_VOTES) for v in votes}
        moved = max(abs(new[v] - reliability[v]) for v in votes)
        reliability = new
        if moved < tolerance:
            break
    survivors = chosen(rows).select(group, "field", F.col("best.value").alias("value"), (-F.col("best.low")).cast("bigint").alias(record_id))
    return survivors, {(names[int(v[3:])], "newest" if v.startswith("new") else "older"): r for v, r in reliability.items()}


def _trust(spark, sf_dir: str) -> dict[str, float]:
    """The fixed list of kinds of sources; discover_truth checks its size."""
    rows = read_table(spark, sf_dir, "source_trust").where(F.col("spec_source").isNotNull()).limit(MOST_SOURCES + 1).collect()
    return {r["spec_source"]: float(r["trust"] or 0) for r in rows}


def _columns(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "device_records").select("product_id", "listing_id", "spec_source", "scraped_at", *FIELDS)


def p6_found(spark, sf_dir: str) -> DataFrame:
    """product_id, field, listing_id for every product with two or more rows and each field with a real value."""
    survivors, _ = discover_truth(_columns(spark, sf_dir), _trust(spark, sf_dir), least_rows=2)
    return survivors.select("product_id", "field", "listing_id")


def p6_survivors(spark, sf_dir: str) -> DataFrame:
    """One record per product_id with the surviving value of each of the six fields (null where no row has a real one)."""
    records = _columns(spark, sf_dir)
    survivors, _ = discover_truth(records, _trust(spark, sf_dir))
    picked = survivors.select("field", F.col("listing_id"), F.col("product_id").alias("__group")).join(records.select("listing_id", *FIELDS), "listing_id")
    return picked.groupBy(F.col("__group").alias("product_id")).agg(*[F.max_by(f if f != "regional_variants" else F.col(f), F.when(F.col("field") == f, 1)).alias(f) for f in FIELDS])
