"""Files arriving one after the other give what one scan of all gives."""

from lunario.sources.delimited import read_series_files
from lunario.streaming.arrivals import clean_arrivals
from test_files import put


def test_arriving_files(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    put(folder, "Contratos desde 2012 por CCAA.csv", "Fecha;Cataluña;León\nene-12;1.234;2,5\n", "latin-1")
    assert clean_arrivals(spark, str(folder), out, checkpoint).awaitTermination(90)
    put(folder, "Parados desde 2010 estatal.csv", "Fecha\tTotal\n02/2010\t7\n")
    assert clean_arrivals(spark, str(folder), out, checkpoint).awaitTermination(90)
    key = lambda r: (r.file_id, r.series, r.ds, r.y)
    got = sorted(map(key, spark.read.parquet(out).collect()))
    assert len(got) == 3
    assert got == sorted(map(key, read_series_files(spark, str(folder)).collect()))
    assert len(spark.read.parquet(out).select("batch").distinct().collect()) == 2
