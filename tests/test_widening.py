import datetime

from pyspark.sql import functions as F

from skarn.functions import cells
from skarn.operators.widening import Attribute, filled, widen

ATTRIBUTES = [Attribute("power", "quantity", "W"), Attribute("slots", "integer", None), Attribute("lock", "boolean", None), Attribute("made", "date", None), Attribute("skin", "text", None)]
SCHEMA = "id long, key string, raw string, value double, unit string, label string, seq int, power string"


def test_cells(spark):
    rows = [("28.0", 28, None, None), ("up to 12", 12, None, None), ("9.5", None, None, None), ("1 200 x", 1200, None, None), ("Yes", None, True, None), ("ohne", None, False, None), ("2023-02-31", 2023, None, None), ("31.12.2022", None, None, datetime.date(2022, 12, 31)),
            ("17 February 2021", 17, None, datetime.date(2021, 2, 17)), ("29/02/2023", 29, None, None), ("k. A.", None, None, None), (None, None, None, None), (" ", None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select("t", cells.whole_number(F.col("t")), cells.yes_or_no(F.col("t")), cells.day(F.col("t"))).collect()
    for g, r in zip(got, rows):
        assert g[2] == r[2] and g[3] == r[3], (g, r)
        if r[1] is None or r[3] is None and "/" not in (r[0] or "") and "-" not in (r[0] or ""):
            assert g[1] == r[1] or r[3], (g, r)


def test_widen(spark):
    rows = [
        (1, "power", "2 kW", None, None, "P", 1, "x"), (1, "power", "n/a", None, None, "P", 9, "x"), (1, "power", "3 kW", None, None, "P", 2, "x"), (1, "slots", "28.0", None, None, None, 1, None), (1, "slots", "2.5", None, None, None, 2, None),
        (1, "lock", "✓", None, None, None, 1, None), (1, "made", "2023-02-31", None, None, None, 1, None), (1, "skin", " steel ", None, None, None, 1, None), (1, "other", "5", None, None, None, 1, None), (1, None, "5", None, None, None, 1, None),
        (2, "power", None, 7.0, "kW", None, 1, None), (2, "lock", "see datasheet", None, None, None, 1, None), (None, "power", "1 W", None, None, None, 1, None), (3, "skin", "", None, None, None, 1, None), (4, "skin", "y" * 40000, None, None, None, 1, None),
    ]
    wide = widen(spark.createDataFrame(rows, SCHEMA), ["id"], ATTRIBUTES, [F.col("seq")])
    got = {r["id"]: r for r in wide.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1]["power"], got[1]["slots"], got[1]["lock"], got[1]["made"], got[1]["skin"]) == (3000.0, 28, True, None, "steel")
    assert got[2]["power"] == 7000.0 and got[2]["lock"] is None and got[3]["skin"] is None and len(got[4]["skin"]) == 40000
    assert {tuple(r) for r in filled(wide, ["id"], ATTRIBUTES).collect()} == {(1, "power"), (1, "slots"), (1, "lock"), (1, "skin"), (2, "power"), (4, "skin")}


def test_widen_nothing(spark):
    wide = widen(spark.createDataFrame([], SCHEMA), ["id"], ATTRIBUTES, [F.col("seq")])
    assert wide.count() == 0 and wide.columns == ["id", "power", "slots", "lock", "made", "skin"]
