"""Parameters by file, records by file, and results replaced as a whole."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lunario.operators import export
from lunario.plans.control import control_rows
from lunario.plans.forecasting import cleaned_panel, forecast_with_rejects, publish, publish_rejects, run_forecast
from lunario.sources import versions
from lunario.sources.delimited import month_panel, read_series_files
from lunario.sources.sinks import write_records

MONTHLY = [f"{2000 + k // 12}-{k % 12 + 1:02d}" for k in range(40)]


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    rows = "".join(f"{m};{50 + k % 12};{90 - k};{k * k}\n" for k, m in enumerate(MONTHLY))
    for name in ("Parados desde 2000 por CCAA.csv", "Afiliados desde 2000 por CCAA 2004-2005.csv"):
        (folder / name).write_text("Fecha;A;B;C\n" + rows)
    return read_series_files(spark, str(folder)).cache()


def controls(spark, **columns):
    row = {"file": "Parados desde 2000 por CCAA.csv", **columns}
    kinds = {"as_of": "date", "forecast_end": "date", "sets": "array<int>", "file": "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'int')}" for c in row))


def ends(forecasts):
    rows = forecasts.groupBy("file_id").agg(F.max("ds").alias("ds")).collect()
    return {r.file_id.rsplit("/", 1)[-1].split(" ")[0]: r.ds for r in rows}


def test_ends_by_row_and_by_name(spark, obs):
    table = controls(spark, forecast_end=dt.date(2003, 9, 20))
    found, _ = forecast_with_rejects(obs, models=["NP"], controls=table)
    assert ends(found) == {"Parados": dt.date(2003, 9, 1), "Afiliados": dt.date(2005, 12, 1)}
    found, _ = forecast_with_rejects(obs, models=["NP"], controls=controls(spark, as_of=dt.date(2001, 5, 5)))
    assert ends(found)["Parados"] == dt.date(2004, 12, 1)
    found, _ = forecast_with_rejects(obs, models=["NP"])
    assert ends(found) == {"Parados": dt.date(2006, 12, 1), "Afiliados": dt.date(2005, 12, 1)}


def test_columns_out_of_range_are_rejects(spark, obs):
    usable, rejects = cleaned_panel(obs, control_rows(controls(spark, first_column=2, last_column=2)))
    kept = {(r.file_id.rsplit("/", 1)[-1][:3], r.series) for r in usable.select("file_id", "series").distinct().collect()}
    assert kept == {("Par", "B"), ("Afi", "A"), ("Afi", "B"), ("Afi", "C")}
    found = publish_rejects(rejects).groupBy("series", "reason").count().collect()
    assert sorted(map(tuple, found)) == [("A", "out_of_range", 40), ("C", "out_of_range", 40)]


def test_sets_by_file(spark, obs):
    table = controls(spark, sets=[2])
    found, _ = forecast_with_rejects(obs, models=["LSTM"], controls=table)
    chosen = found.where("file_id like '%/Parados%'").select("param_id").distinct().collect()
    assert [r.param_id for r in chosen] == [2]


def test_several_rows_for_a_file_and_none(spark):
    table = controls(spark, forecast_end=dt.date(2003, 1, 1)).unionByName(controls(spark, forecast_end=dt.date(2004, 1, 1)))
    assert [r.forecast_end for r in control_rows(table).collect()] == [dt.date(2004, 1, 1)]
    assert control_rows(table.where("false")).collect() == []


def test_records_of_a_file_in_parts(spark, obs, tmp_path):
    forecasts, _ = forecast_with_rejects(obs, models=["NP"])
    published = publish(forecasts).withColumn("yhat", F.when(F.col("series") == "B", F.lit(float("nan"))).otherwise(F.col("yhat")))
    records = export.file_records(published, month_panel(obs), part_series=2).cache()
    rows = records.collect()
    assert {(r.metrica, r.modo, r.atributo, r.modelo, r.anio_inicio, r.partes) for r in rows} == {
        ("Parados", "atributo", "CCAA", "NP", 2000, 2), ("Afiliados", "atributo", "CCAA", "NP", 2000, 2),
    }
    for metric in ("Parados", "Afiliados"):
        series = [s for r in rows if r.metrica == metric for s in r.pronostico]
        assert sorted(series) == ["A", "B", "C"]
    assert all(len(points) == 40 for r in rows for points in r.historico.values())
    write_records(records, str(tmp_path / "records"))
    lines = [json.loads(v.value) for v in spark.read.text(str(tmp_path / "records")).collect()]
    assert any(p.get("valor") is None for line in lines for p in line["pronostico"].get("B", []))
    errors = export.export_error_table(export.file_errors(records)).collect()
    assert {r.titulo for r in errors} == {"MAPE esperado 1 año promedio CCAA"} and len(errors) == 2


def test_a_run_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    target = str(tmp_path / "out")
    one, two = spark.range(1).toDF("n"), spark.range(2).toDF("n")
    with pytest.raises(ValueError):
        versions.read_current(spark, target, "a")
    versions.replace({"a": one, "b": one}, target)
    held = versions.read_current(spark, target, "a")
    aside = versions.write_version({"a": two, "b": two}, target)
    assert [versions.read_current(spark, target, n).count() for n in "ab"] == [1, 1]
    broken = two.select(F.raise_error(F.lit("lost")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        versions.replace({"a": two, "b": broken}, target)
    assert [versions.read_current(spark, target, n).count() for n in "ab"] == [1, 1]
    versions.publish_version(spark, target, aside, ["a", "b"])
    assert [versions.read_current(spark, target, n).count() for n in "ab"] == [2, 2]
    assert held.count() == 1


def test_a_run_is_published_as_one(spark, obs, tmp_path):
    target = str(tmp_path / "run")
    run_forecast(obs, target, models=["NP"], controls=controls(spark, first_column=2))
    assert versions.read_current(spark, target, "rejects").where("reason = 'out_of_range'").count() == 40
    assert versions.read_current(spark, target, "forecasts").select("file_id", "series").distinct().count() == 5
