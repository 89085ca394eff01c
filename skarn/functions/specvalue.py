"""A specification's raw text as a typed struct, in Column expressions.

Readings are tried in this order: yes or no, dimensions (anywhere in the text), range, set of numbers, one number, comparison
(anywhere), text. Values that only partly match stay text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.text import let, squeeze

UNIT = r"[°µμ]?[A-Za-zΩ%°/·.\s]{0,14}"
LAZY_UNIT = UNIT + "?"
NUMBER = r"[-+]?\d+(?:[.,]\d+)*"
RANGE = rf"(?i)^\s*({NUMBER})\s*(?:\.{{2,3}}|-|–|—|to|bis)\s*({NUMBER})\s*({LAZY_UNIT})\s*(?:\(.*\))?\s*$"
COMPARISON = rf"(<=|>=|<|>|≤|≥)\s*({NUMBER})\s*({UNIT})"
DIMENSIONS = rf"(?i)({NUMBER})\s*({LAZY_UNIT})\s*[x×]\s*({NUMBER})\s*({LAZY_UNIT})\s*[x×]\s*({NUMBER})\s*({UNIT})"
SIMPLE = rf"^\s*({NUMBER})\s*({UNIT})$"
SET = rf"^\s*({NUMBER})(?:\s*/\s*({NUMBER}))+\s*({UNIT})$"
# Words that are yes and no.
TRUE = ["yes", "ja", "standard", "included", "available", "✓", "x"]
FALSE = ["no", "nein", "none", "not available", "n/a", "na", "-", "--", "—"]
SPEC_VALUE = "struct<raw:string,kind:string,value:double,value_min:double,value_max:double,unit:string,comparator:string,values:array<double>,text:string>"


def parse_number(text: Column) -> Column:
    """A number's text as double: of comma and dot the last is the decimal mark; a lone comma before exactly three digits
    groups thousands; several dots are no number."""
    t = F.trim(text)
    dot, comma = F.instr(t, "."), F.instr(t, ",")
    last_dot, last_comma = F.length(t) - F.locate(".", F.reverse(t)), F.length(t) - F.locate(",", F.reverse(t))
    no = lambda c, mark: F.replace(c, F.lit(mark), F.lit(""))
    to_dot = lambda c: F.replace(c, F.lit(","), F.lit("."))
    plain = (
        F.when((dot > 0) & (comma > 0), F.when(last_comma > last_dot, to_dot(no(t, "."))).otherwise(no(t, ",")))
        .when(comma > 0, F.when(F.length(F.substring_index(t, ",", -1)) == 3, no(t, ",")).otherwise(to_dot(t)))
        .otherwise(t)
    )
    return let(plain, lambda p: F.when(p.rlike(r"^[-+]?\d+(\.\d+)?$"), p.try_cast("double")))


def clean_unit(text: Column) -> Column:
    """Without blanks, dots and middle dots at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"^[ .·]+|[ .·]+$", ""), r"\s+", " "), F.lit(""))


def spec_value(raw: Column) -> Column:
    """struct of SPEC_VALUE; null and blank texts are text ""."""

    def of(t: Column) -> Column:
        g = lambda pattern, n: F.regexp_extract(t, pattern, n)
        null, none = F.lit(None).cast("double"), F.lit(None).cast("string")
        empty = F.array().cast("array<double>")

        def made(kind, value=null, low=null, high=null, unit=none, comparator=none, values=empty, text=none):
            return F.struct(t.alias("raw"), F.lit(kind).alias("kind"), value.alias("value"), low.alias("value_min"), high.alias("value_max"), unit.alias("unit"), comparator.alias("comparator"), values.alias("values"), text.alias("text"))

        word = F.regexp_replace(F.lower(t), r"^[ .]+|[ .]+$", "")
        three = F.array(*[parse_number(g(DIMENSIONS, i)) for i in (1, 3, 5)])
        units = F.coalesce(*[F.nullif(g(DIMENSIONS, i), F.lit("")) for i in (6, 4, 2)], F.lit(""))
        numbers = F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1)), parse_number), lambda x: x.isNotNull())
        return (
            F.when(t == "", made("text", text=t))
            .when(word.isin(*TRUE), made("boolean", F.lit(1.0), text=t))
            .when(word.isin(*FALSE), made("boolean", F.lit(0.0), text=t))
            .when(t.rlike(DIMENSIONS) & ~F.exists(three, lambda x: x.isNull()), made("dimensions", values=three, unit=clean_unit(units)))
            .when(t.rlike(RANGE) & parse_number(g(RANGE, 1)).isNotNull() & parse_number(g(RANGE, 2)).isNotNull(), made("range", low=parse_number(g(RANGE, 1)), high=parse_number(g(RANGE, 2)), unit=clean_unit(g(RANGE, 3))))
            .when(t.rlike(SET) & (F.size(numbers) > 0), made("number", F.get(numbers, F.lit(0)), unit=clean_unit(g(SET, 3)), values=numbers))
            .when(t.rlike(SIMPLE) & parse_number(g(SIMPLE, 1)).isNotNull(), made("number", parse_number(g(SIMPLE, 1)), unit=clean_unit(g(SIMPLE, 2))))
            .when(t.rlike(COMPARISON) & parse_number(g(COMPARISON, 2)).isNotNull(), made("comparison", parse_number(g(COMPARISON, 2)), unit=clean_unit(g(COMPARISON, 3)), comparator=g(COMPARISON, 1), text=t))
            .otherwise(made("text", text=t))
        )

    return let(squeeze(F.coalesce(raw, F.lit(""))), of)
