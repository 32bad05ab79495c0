"""Scanning of hand-made files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lunario.plans.forecasting import cleaned_panel
from lunario.sources import delimited, sinks


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return path


@pytest.fixture
def files(tmp_path):
    put(
        tmp_path,
        "Contratos desde 2012 por CCAA.csv",
        'Fecha;"Castilla; León";Cataluña\r\nENERO DE 2012;1.234,5;\'-\r\n\r\nfeb-12;"2.000";12x\r\nmal;1;2\r\n',
        "latin-1",
    )
    put(tmp_path, "Parados desde 2010 estatal.csv", "﻿Total\tDATE\n10\t2010-01-31\n20\t02/2010\n")
    put(tmp_path, "Afiliados desde 2010 estatal.csv", "Fecha;Total\n")
    put(tmp_path, "notas.csv", 'Mes;"dice ""hola"""\n01/02/2020;5\n')
    return str(tmp_path)


def test_scan(spark, files):
    obs = delimited.read_series_files(spark, files).cache()
    rows = {(r.file_id.rsplit("/", 1)[-1].split(" ")[0], r.series, r.fecha_raw): (r.ds, r.y, r.col_pos) for r in obs.where("col_pos > 0").collect()}
    jan, feb = dt.date(2012, 1, 1), dt.date(2012, 2, 1)
    assert rows == {
        ("Contratos", "Castilla; León", "ENERO DE 2012"): (jan, 1234.5, 1),
        ("Contratos", "Cataluña", "ENERO DE 2012"): (jan, None, 2),
        ("Contratos", "Castilla; León", "feb-12"): (feb, 2000.0, 1),
        ("Contratos", "Cataluña", "feb-12"): (feb, None, 2),
        ("Contratos", "Castilla; León", "mal"): (None, 1.0, 1),
        ("Contratos", "Cataluña", "mal"): (None, 2.0, 2),
        ("Parados", "Total", "2010-01-31"): (dt.date(2010, 1, 1), 10.0, 1),
        ("Parados", "Total", "02/2010"): (dt.date(2010, 2, 1), 20.0, 1),
        ("notas.csv", 'dice "hola"', "01/02/2020"): (dt.date(2020, 2, 1), 5.0, 1),
    }
    accepted, rejected = delimited.split_rejects(obs)
    assert sorted(r.reason for r in rejected.collect()) == ["bad_date", "bad_date", "bad_number", "no_rows"]
    assert accepted.count() == 6
    last = {r.file_id.rsplit("/", 1)[-1]: r.last_ds for r in delimited.last_month(obs).collect()}
    assert last["Contratos desde 2012 por CCAA.csv"] == feb


def test_cleaned_panel_reports_unknown_names(spark, files):
    panel, rejects = cleaned_panel(delimited.read_series_files(spark, files))
    assert {r.reason for r in rejects.collect()} == {"bad_date", "bad_number", "bad_name", "no_rows"}
    assert {(r.metric_group, r.scope) for r in panel.collect()} == {("de", "atributo"), ("abc", "estatal")}


def test_large_file_is_split_and_kept_in_order(spark, tmp_path):
    """The header is found and the last duplicate month wins when one file spans many tasks."""
    months = [f"{y}-{m:02d}" for y in range(1000, 2000) for m in range(1, 13)]
    lines = [f"{m};{i}" for i, m in enumerate(months)] + [f"{m};{-i}" for i, m in enumerate(months)]
    put(tmp_path, "Parados desde 1000 estatal.csv", "Fecha;Total año\n" + "\n".join(lines) + "\n", "latin-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines_df = delimited.read_lines(spark, str(tmp_path))
        assert lines_df.rdd.getNumPartitions() > 5
        obs = delimited.read_series_files(spark, str(tmp_path))
        assert obs.count() == 24_000
        panel = delimited.month_panel(obs)
        got = panel.agg(F.count(F.lit(1)), F.sum("y"), F.min("series")).first()
        assert tuple(got) == (12_000, -sum(range(12_000)), "Total año")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_series_range_applies_whatever_the_width(spark):
    rows = spark.range(1, 61).select(
        F.lit("wide").alias("file_id"), F.col("id").cast("int").alias("col_pos"), F.lit(60).alias("n_series")
    ).union(spark.range(1, 6).select(F.lit("small"), F.col("id").cast("int"), F.lit(5)))
    kept = delimited.select_series_range(rows, 3, 10)
    assert {r.file_id: r.n for r in kept.groupBy("file_id").agg(F.count("*").alias("n")).collect()} == {
        "wide": 8,
        "small": 3,
    }
    assert {r.file_id: r.needs_range for r in delimited.wide_file_gate(rows).collect()} == {
        "wide": True,
        "small": False,
    }


def test_cleaned_wide_files_can_be_scanned_again(spark, files, tmp_path):
    obs = delimited.read_series_files(spark, files).where("file_id like '%/Contratos%'")
    out = str(tmp_path / "out")
    sinks.write_clean_wide(obs, ["Castilla; León", "Cataluña"], out)
    again = delimited.read_series_files(spark, f"{out}/*")
    key = lambda r: (r.file_id, r.series, str(r.ds), r.y)
    assert sorted(map(key, again.collect()), key=str) == sorted(map(key, obs.collect()), key=str)


def test_surplus_cells_repeated_headers_and_empty_files(spark, tmp_path):
    put(tmp_path, "Parados desde 2010 por CCAA.csv", "Fecha;A;A\n2010-01;1;2;\n2010-02;3;4;5;6\n2010-03;7\n")
    put(tmp_path, "Afiliados desde 2010 por CCAA.csv", "Fecha;A\n\n  \n")
    put(tmp_path, "Contratos desde 2010 por CCAA.csv", "Fecha\n2010-01\n")
    put(tmp_path, "Demandantes desde 2010 por CCAA.csv", "Fecha;A\nene 123;4\n")
    accepted, rejected = delimited.split_rejects(delimited.read_series_files(spark, str(tmp_path)))
    assert sorted((r.series, r.ds.month, r.y) for r in accepted.where("y is not null").collect()) == [
        ("A", 1, 1.0), ("A", 2, 3.0), ("A", 3, 7.0), ("A.1", 1, 2.0), ("A.1", 2, 4.0)
    ]
    found = sorted((r.file_id.rsplit("/", 1)[-1].split(" ")[0], r.reason, r.raw or "") for r in rejected.collect())
    assert found == [
        ("Afiliados", "no_rows", ""),
        ("Contratos", "no_rows", ""),
        ("Demandantes", "bad_year", "4"),
        ("Parados", "extra_cells", "5"),
        ("Parados", "extra_cells", "6"),
    ]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        put(tmp_path / folder, "Parados desde 2010 estatal.CSV", f"Fecha;Total\n2010-01;{value}\n")
    panel, _ = cleaned_panel(delimited.read_series_files(spark, f"{tmp_path}/*"))
    assert sorted(r.y for r in panel.collect()) == [1.0, 2.0]


def test_header_does_not_depend_on_how_files_are_packed(spark, tmp_path):
    for k in range(6):
        rows = "".join(f"{2000 + m // 12}-{m % 12 + 1:02d};{m}\n" for m in range(12))
        put(tmp_path, f"Parados desde 200{k} estatal.csv", "Fecha;Total\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        files = delimited.written(delimited.profile_files(delimited.read_lines(spark, str(tmp_path))), "profile")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows, repeated = delimited.rows_with(delimited.read_lines(spark, str(tmp_path)).coalesce(1), files)
    assert repeated.count() == 0
    assert rows.count() == 72


def test_a_repeated_header_is_a_reject(spark, tmp_path):
    head = "﻿Fecha;A\n"
    lines = ["2010-01;1", "Fecha;A", "2010-02;2", "Fecha;A", "Fecha;A", "2010-03;3"]
    put(tmp_path, "Parados desde 2010 por CCAA.csv", head + "\n".join(lines) + "\n")
    for size in ("20", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            accepted, rejected = delimited.split_rejects(delimited.read_series_files(spark, str(tmp_path)))
            assert sorted(r.y for r in accepted.collect()) == [1.0, 2.0, 3.0]
            assert [(r.reason, r.raw) for r in rejected.collect()] == [("repeated_header", "Fecha;A")] * 3
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


SPANNING = 'Fecha;"Castilla\ny León";B\n2010-01;"1\n";"2"\n2010-02;"";"7 ""x""\n\n;"";\n5"\n2010-03;5" pipe;4\n"2010-\n04";8;9\n'


@pytest.mark.parametrize("size", ["7", "134217728"])
def test_quoted_line_breaks(spark, tmp_path, size):
    """Whatever the blocks, against Python's own reader."""
    import csv
    import io

    put(tmp_path, "Parados desde 2010 por CCAA.csv", SPANNING)
    put(tmp_path, "Contratos desde 2010 por CCAA.csv", SPANNING.replace(";", "\t"), "latin-1")
    put(tmp_path, "Afiliados desde 2010 estatal.csv", "Fecha;A\n2010-01;1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        obs = delimited.read_series_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in obs:
        got.setdefault(r.file_id.rsplit("/", 1)[-1].split(" ")[0], []).append((r.fecha_raw, r.series, r.raw))
    for name, sep in (("Parados", ";"), ("Contratos", "\t")):
        head, *rows = csv.reader(io.StringIO(SPANNING.replace(";", sep)), delimiter=sep)
        assert sorted(got[name]) == sorted((row[0], h, v) for row in rows for h, v in zip(head[1:], row[1:]))
    assert got["Afiliados"] == [("2010-01", "A", "1")]


def test_random_quotes_against_a_state_machine(spark, tmp_path):
    import csv
    import io
    import random

    draw = random.Random(4)
    texts = {}
    for k in range(4):
        rows = [[f"{2000 + n}-01", *("".join(draw.choice('ab;"\n') for _ in range(draw.randint(0, 6))) for _ in "xy")] for n in range(12)]
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="\n").writerows([["Fecha", "A", "B"], *rows])
        texts[f"Parados desde 20{k:02d} por CCAA.csv"] = (out.getvalue(), rows)
    for name, (content, _) in texts.items():
        put(tmp_path, name, content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        obs = delimited.read_series_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in obs:
        got.setdefault(r.file_id.rsplit("/", 1)[-1], []).append((r.fecha_raw, r.series, r.raw))
    for name, (_, rows) in texts.items():
        assert sorted(got[name]) == sorted((d, s, v) for d, *values in rows for s, v in zip("AB", values))


def test_quotes_that_never_close(spark, tmp_path):
    put(tmp_path, "Parados desde 2010 por CCAA.csv", 'Fecha;A\n2010-01;"1\n"\n2010-02;"2\n2010-03;3\n2010-04;4\n')
    for size in ("20", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            accepted, rejected = delimited.split_rejects(delimited.read_series_files(spark, str(tmp_path)))
            assert [r.fecha_raw for r in accepted.collect()] == ["2010-01"]
            found = sorted((r.reason, r.raw) for r in rejected.collect())
            assert found == [("open_quote", t) for t in ('2010-02;"2', "2010-03;3", "2010-04;4")]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
