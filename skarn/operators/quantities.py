"""Problem 1: quantities recorded in different units, put into the common unit of their attribute."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.units import conversion, unit_in_label
from skarn.session import read_table, ship_package, spread

# A number with digit groups; spaces between groups are closed up before.
NUMBER = r"(?:(?<![\w.,])[-−])?\d+(?:[.,']\d+)*"
#: Signs and words between the ends of a range.
BETWEEN = r"(?:\.\.\.|…|[-–—~]|to|bis|à|until|jusqu'à)"
QUANTITY = re.compile(rf"({NUMBER})(?:\s*(?:[^\d\s]{{1,8}})??\s*{BETWEEN}\s*({NUMBER}))?")
_SPACES, _GROUPS = re.compile(r"[\s\u200b\u202f]+"), re.compile(r"(?<=\d) (?=\d{3}(?!\d))")


def closed_up(text: str) -> str:
    """White space of all kinds as one space; spaces between a number's digit groups removed."""
    return _GROUPS.sub("", _SPACES.sub(" ", text))


def number_readings(token: str) -> tuple[float, float | None]:
    """(usual, other) reading of a number token; other is None unless the token is ambiguous.

    With both marks the last is the decimal mark; a mark that repeats groups thousands; one comma before exactly three
    digits groups thousands unless the whole part is 0; else the mark is decimal.
    """
    t = token.replace("−", "-").replace("'", "")
    dots, commas = t.count("."), t.count(",")
    if dots and commas:
        group, mark = (".", ",") if t.rfind(",") > t.rfind(".") else (",", ".")
        t = t.replace(group, "")
        return (float(t.replace(mark, ".")) if t.count(mark) == 1 else float(t.replace(mark, ""))), None
    if dots > 1 or commas > 1:
        return float(t.replace(".", "").replace(",", "")), None
    if not dots and not commas:
        return float(t), None
    whole, part = t.replace(",", ".").split(".")
    decimal, grouped = float(f"{whole}.{part}"), float(whole + part)
    if len(part) == 3 and whole.lstrip("-")[0] != "0" and len(whole.lstrip("-")) <= 3:
        return (grouped, decimal) if commas else (decimal, grouped)
    return decimal, None


def quantity_in(text: str) -> tuple[float, float | None, float | None, str] | None:
    """(upper, its other reading, lower, what follows) of the first quantity of a text; None if it holds no number."""
    text = closed_up(text)
    found = QUANTITY.search(text)
    if not found:
        return None
    upper, other = number_readings(found[2] or found[1])
    return upper, other, number_readings(found[1])[0] if found[2] else None, text[found.end() :].strip()


def read_quantity(common_unit: str, by_value: bool, text: str | None, value: float | None, unit: str | None, label: str | None) -> tuple | None:
    """(upper, other, lower, scale, shift, stated) of one row; None without a quantity. stated: text, label or none."""
    if by_value:
        if value is None or value != value:
            return None
        upper, other, lower, rest = value, None, None, (unit or "").strip()
    else:
        got = quantity_in(text)
        if got is None:
            return None
        upper, other, lower, rest = got
    found, stated = (conversion(rest, common_unit), "text") if rest else (None, "none")
    if found is None and label:
        found, stated = unit_in_label(label, common_unit), "label"
    return (upper, other, lower, *found, stated) if found else (upper, other, lower, 1.0, 0.0, "none")


READING = "struct<upper double, other double, lower double, scale double, shift double, stated string>"


def quantity_reading(common_unit: pd.Series, raw: pd.Series, value: pd.Series, unit: pd.Series, label: pd.Series) -> pd.DataFrame:
    """The quantity of each row; all null where there is none. Equal rows of a batch are read once."""
    memo: dict[tuple, tuple] = {}
    empty = (None, None, None, None, None, None)
    out = []
    for to, text, number, name, title in zip(common_unit, raw, value, unit, label):
        key = (to, text, number if text is None else None, name if text is None else None, title)
        if key not in memo:
            memo[key] = read_quantity(to, text is None, text, number, name, title) or empty
        out.append(memo[key])
    return pd.DataFrame(out, columns=["upper", "other", "lower", "scale", "shift", "stated"])


def normalise_quantities(values: DataFrame, attributes: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Rows of values whose attribute has a common unit and that write a quantity, with the quantity in that unit.

    values: raw, value, unit, label, attribute and any more columns; attributes: attribute, common_unit; classes:
    attribute, lower_bound (inclusive), upper_bound, class_id. raw decides when it isn't null, else value and unit.
    Adds common_unit, amount (of a range the upper end, of a bound the bound), amount_low (lower end of a range, else
    null), scale, shift, stated (where the unit stands: text, label or none) and class_id (null without classes or
    outside them). Null, blank and stand-in texts have no quantity and give no row, as does a null attribute; an empty
    table gives none. Repeated rows stay repeated. Both small tables are the fixed reference lists (tens of rows) and
    are broadcast; there is no shuffle. A number that can be read two ways ("1,234") takes the usual reading unless
    only the other lies within the attribute's classes.
    """
    ship_package(values.sparkSession)
    refs = attributes.where(F.col("common_unit").isNotNull()).select(F.col("attribute").alias("__key"), F.col("common_unit").alias("__common"))
    more = [c for c in values.columns if c not in ("common_unit", "amount", "amount_low", "scale", "shift", "stated", "class_id")]
    df = spread(values.select(*more)).join(F.broadcast(refs), F.col("attribute") == F.col("__key"))
    df = df.withColumn("__q", F.pandas_udf(quantity_reading, READING)("__common", "raw", "value", "unit", "label")).where(F.col("__q.upper").isNotNull())
    into = lambda c: F.expr(f"cast(format_string('%.11e', {c} * __q.scale + __q.shift) as double)")
    df = df.withColumns({"__a": into("__q.upper"), "__b": F.when(F.col("__q.other").isNotNull(), into("__q.other")), "__low": F.when(F.col("__q.lower").isNotNull(), into("__q.lower"))})
    if classes is None:
        df = df.withColumn("__class", F.lit(None).cast("int")).withColumn("__amount", F.col("__a"))
    else:
        spans = classes.groupBy(F.col("attribute").alias("__k")).agg(F.collect_list(F.struct("lower_bound", "upper_bound", "class_id")).alias("__spans"))
        df = df.join(F.broadcast(spans), F.col("__key") == F.col("__k"), "left").drop("__k")
        within = lambda c: f"get(filter(__spans, s -> {c} >= s.lower_bound and {c} < s.upper_bound), 0).class_id"
        df = df.withColumn("__ca", F.expr(within("__a"))).withColumn("__cb", F.expr(within("__b")))
        other = F.col("__ca").isNull() & F.col("__cb").isNotNull()
        df = df.withColumn("__amount", F.when(other, F.col("__b")).otherwise(F.col("__a"))).withColumn("__class", F.coalesce("__ca", "__cb").cast("int"))
    return df.select(
        *more, F.col("__common").alias("common_unit"), F.col("__amount").alias("amount"), F.col("__low").alias("amount_low"),
        F.col("__q.scale").alias("scale"), F.col("__q.shift").alias("shift"), F.col("__q.stated").alias("stated"), F.col("__class").alias("class_id"),
    )


def changed_by_conversion(normalised: DataFrame) -> DataFrame:
    """Rows whose number changes when put into the common unit: units of equal size are no change."""
    return normalised.where((F.abs(F.col("scale") - 1) > 1e-9) | (F.abs(F.col("shift")) > 1e-9))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """spec_id, class_id of spec_values whose number changes; amounts outside every class give no row."""
    values = read_table(spark, sf_dir, "spec_values").select("spec_id", "attribute", "label", "raw", "value", "unit")
    found = changed_by_conversion(normalise_quantities(values, read_table(spark, sf_dir, "attribute_refs"), read_table(spark, sf_dir, "quantity_classes")))
    return found.where(F.col("class_id").isNotNull()).select("spec_id", "class_id")
