"""Edge values of the text rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lunario.functions import calendar, text
from lunario.operators import registry
from lunario.sources.names import logical_file, parse_series_name


def evaluate(spark, inputs, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


MONTHS = {
    "2020-03": dt.date(2020, 3, 1),
    "2020-03-15x": dt.date(2020, 3, 1),
    "2020-99": None,
    "15/03/2020": dt.date(2020, 3, 1),
    "15/03/2020 10:00": dt.date(2020, 3, 1),
    "03/2020": dt.date(2020, 3, 1),
    "03-2020": dt.date(2020, 3, 1),
    "13-2020": None,
    "ENERO DE 2012": dt.date(2012, 1, 1),
    "Enero  de  2012": dt.date(2012, 1, 1),
    "ENE 2012": dt.date(2012, 1, 1),
    "ene-12": dt.date(2012, 1, 1),
    "Septiembre 2012": dt.date(2012, 9, 1),
    " dic-99 ": dt.date(2099, 12, 1),
    "ene 123": dt.date(123, 1, 1),
    "sept 2012": None,
    "foo de 2012": None,
    "ene de 12": None,
    "1/3/2020": None,
    "01-02-2020": None,
    "5": None,
    "": None,
    None: None,
}


def test_normalize_month(spark):
    assert evaluate(spark, list(MONTHS), text.normalize_month) == list(MONTHS.values())


NUMBERS = {
    "1.234.567": 1234567.0,
    "1.234,56": 1234.56,
    "1234,56": 1234.56,
    "1234.56": 1234.56,
    "1.234": 1234.0,
    "0.125": 125.0,
    "12,345.67": None,
    "1,234,567": None,
    "-1.234": -1234.0,
    "1.2.3": 123.0,
    " 12 ": 12.0,
    "12d": None,
    "NaN": None,
    "Infinity": None,
    "1e3": 1000.0,
    "'-": None,
    "NA": None,
    "-": None,
    "N/A": None,
    "": None,
    None: None,
}


def test_clean_number(spark):
    assert evaluate(spark, list(NUMBERS), text.clean_number) == list(NUMBERS.values())


NAMES = {
    "Parados desde 2010 estatal.csv": ("Parados", 2010, "estatal", None, None, None),
    "parados DESDE 2010 ESTATAL": ("parados", 2010, "estatal", None, None, None),
    "Contratos desde 2012 por provincias.CSV": ("Contratos", 2012, "atributo", "provincias", None, None),
    "Afiliados desde 2015 por CCAA 2025-2028.csv": ("Afiliados", 2015, "atributo", "CCAA", 2025, 2028),
    "Parados desde 2010 estatal 2025-2028.csv": ("Parados", 2010, "estatal", None, 2025, 2028),
    "P. contratadas desde 2012 por Sección A.csv": ("P. contratadas", 2012, "atributo", "Sección A", None, None),
    "Parados 2010 estatal.csv": (None,) * 6,
    "otra cosa.csv": (None,) * 6,
}


def test_parse_series_name(spark):
    got = evaluate(spark, list(NAMES), parse_series_name)
    assert [tuple(r) for r in got] == list(NAMES.values())


@pytest.mark.parametrize(
    "path, name",
    [
        ("file:/d/Parados%20desde%202010%20estatal.csv", "file:/d/Parados desde 2010 estatal.csv"),
        ("file:/d/a+b.csv/part-0000-x.csv", "file:/d/a+b.csv"),
        ("s3://b/file_id=x%20y.csv/part-0.csv", "x y.csv"),
        ("s3://b/file_id=s3%253A%252F%252Fa%252Fx.csv/part-0.csv", "s3://a/x.csv"),
        ("file:/d/X.CSV", "file:/d/X.CSV"),
        ("file:/d/plain.txt", "file:/d/plain.txt"),
    ],
)
def test_logical_file(spark, path, name):
    assert evaluate(spark, [path], logical_file) == [name]


def test_rounding_is_half_even(spark):
    got = evaluate(spark, ["0.5", "1.5", "2.5", "-2.5", None], lambda c: text.round_half_even(c.cast("double")))
    assert got == [0, 2, 2, -2, None]


def test_names_for_export(spark):
    got = evaluate(spark, ["Sección/A b"], text.sanitize_name)
    assert got == ["Sección_A_b"]
    assert evaluate(spark, ["a/b:c[1]"], text.sheet_name) == ["a_b_c_1_"]
    long = evaluate(spark, ["a/b:c[1]" + "x" * 40, "a/b:c[1]" + "x" * 41], text.sheet_name)
    assert len(set(long)) == 2 and all(len(s) == 31 and s.startswith("a_b_c_1_" + "x" * 14) for s in long)


def test_exponents_and_white_space(spark):
    got = evaluate(spark, ["1e99", "1e100", "1e999", "7\u00a0", "\u2003 8 \u3000"], text.clean_number)
    assert got == [1e99, 1e100, None, 7.0, 8.0]


def test_horizon(spark):
    rows = spark.sql("select date'2024-11-01' as last")
    end = calendar.default_horizon(F.col("last"))
    row = rows.select(
        end.alias("end"),
        calendar.horizon_months(F.col("last"), end).alias("h"),
        F.size(calendar.future_months(F.col("last"), end)).alias("n"),
        F.size(calendar.future_months(end, F.col("last"))).alias("none"),
        calendar.next_month(F.add_months("last", 1)).alias("wrap"),
    ).first()
    assert tuple(row) == (dt.date(2027, 12, 1), 37, 37, 0, dt.date(2025, 1, 1))


def test_registry(spark):
    rows = spark.createDataFrame(
        [(" Parados ", "estatal", "LSTM"), ("Contratos", "atributo", "LSTM"), ("Empleo", "estatal", "NP")],
        "metric string, scope string, model string",
    )
    grouped = registry.with_metric_group(rows)
    assert [r.metric for r in registry.available_models(grouped).collect()] == [" Parados "]
    assert {r.metric for r in registry.unavailable_models(grouped).collect()} == {"Contratos", "Empleo"}
    assert registry.with_models(grouped.drop("model")).count() == 4
