import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.functions.units import best_unit, common, conversion, fold_unit, parses, unit_in_label
from skarn.operators.quantities import changed_by_conversion, normalise_quantities, number_readings, quantity_in

CASES = [
    ("kW", "W", 1000), ("KW nominal", "W", 1000), ("Btu/hr", "W", 0.29307107), ("US gal/min", "L/min", 3.785411784), ("gal (US) (with 3 trays)", "L", 3.785411784), ("m3/h", "L/min", 1000 / 60),
    ("cu. ft.", "L", 28.316846592), ("min nominal", "min", 1), ("Std.", "min", 60), ("kWh/24 h (empty)", "kWh/d", 1), ("kWh/a", "kWh/d", 1 / 365), ("×10³ min⁻¹", "rpm", 1000), ("x1000 rpm", "rpm", 1000),
    ("1/s", "rpm", 60), ("U/min", "rpm", 1), ("lbf/in² ±5 %", "bar", 0.0689475729), ("millibar", "bar", 0.001), ("Å @ 1013 hPa", "nm", 0.1), ("μm", "nm", 1000), ('"', "mm", 25.4), ("°C per hour", "K/min", 1 / 60),
    ("°F/min", "K/min", 5 / 9), ("litres per minute per module", "L/min", 1), ("lb. per module", "kg", 0.45359237), ("nanolitres", "µL", 0.001), ("MJ/d", "kWh/d", 1 / 3.6),
]


@pytest.mark.parametrize("text,to,scale", CASES)
def test_conversion(text, to, scale):
    got = conversion(text, to)
    assert got is not None and got[0] == pytest.approx(scale) and got[1] == 0


def test_temperatures_shift():
    assert conversion("K", "°C") == pytest.approx((1, -273.15))
    assert conversion("° F", "°C") == pytest.approx((5 / 9, -160 / 9))
    assert conversion("degC", "°C")[1] == 0


def test_other_dimensions_are_no_unit():
    assert conversion("kg", "W") is None
    assert conversion("", "W") is None
    assert conversion("modules fitted", "min") is None


def test_prior_chooses_among_decompositions():
    assert {u.dims for u in parses("mm Hg")} >= {common("bar").dims, common("mm").dims}
    assert best_unit("mm Hg", common("bar").dims).end == 5 and best_unit("mm Hg", common("mm").dims).end == 2
    assert best_unit("min", common("min").dims).factor == 60


def test_labels():
    assert unit_in_label("Energy consumption per day in kWh/year", "kWh/d")[0] == pytest.approx(1 / 365)
    assert unit_in_label("Maximum speed [min⁻¹]", "rpm") == (1.0, 0.0)
    assert unit_in_label("Energy consumption per day", "kWh/d") is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=12))
def test_any_text_parses(text):
    parses(fold_unit(text))


def test_numbers():
    assert number_readings("1.860,0") == (1860.0, None)
    assert number_readings("15,233") == (15233.0, 15.233)
    assert number_readings("0,284") == (0.284, None)
    assert number_readings("1.234.567") == (1234567.0, None)
    assert quantity_in("10 mm to 20 mm")[0] == 20 and quantity_in("-80 °C")[0] == -80
    assert quantity_in("1 440 Wh/d")[0] == 1440 and quantity_in("8900 to 22,621 nanolitres")[0] == 22621
    assert quantity_in("see datasheet") is None


SCHEMA = "spec_id long, attribute string, label string, raw string, value double, unit string, amount string"


def _run(spark, rows):
    attributes = spark.createDataFrame([("power", "W"), ("kind", None), (None, "W")], "attribute string, common_unit string")
    classes = spark.createDataFrame([(1, "power", 1.0, 100.0), (2, "power", 100.0, 10000.0)], "class_id int, attribute string, lower_bound double, upper_bound double")
    return normalise_quantities(spark.createDataFrame(rows, SCHEMA), attributes, classes)


def test_operator_edges(spark):
    rows = [
        (1, "power", "Power", "2 kW", None, None, "clash"), (1, "power", "Power", "2 kW", None, None, "clash"), (2, "power", "Power in kW", "3", None, None, ""), (3, "power", None, None, 5.0, "kW", None), (4, "power", None, None, None, "kW", None),
        (5, "power", "Power", "", None, None, None), (6, "power", "Power", "n/a", None, None, None), (7, "kind", "Kind", "5 kW", None, None, None), (8, None, "x", "5 kW", None, None, None), (9, "power", "Power", "50 watts", None, None, None),
        (10, "power", "Power", "up to 5 kW " + "x" * 50000, None, None, None), (11, "power", None, "99", None, None, None),
    ]
    got = {r["spec_id"]: r for r in _run(spark, rows).collect()}
    assert sorted(got) == [1, 2, 3, 9, 10, 11]
    assert got[1]["amount"] == 2000 and got[1]["class_id"] == 2 and got[2]["stated"] == "label" and got[3]["amount"] == 5000 and got[11]["stated"] == "none"
    assert sorted(r["spec_id"] for r in changed_by_conversion(_run(spark, rows)).collect()) == [1, 1, 2, 3, 10]


def test_operator_on_nothing(spark):
    assert _run(spark, []).count() == 0
