import struct

import numpy as np
import pytest

from centra import cli
from centra.plans import bench, report
from centra.sources import record_files, vector_files
from centra.streaming.online import Centers, follow


@pytest.mark.parametrize(("kind", "code", "values"), [("float", "<f4", [[1.5, -2.0], [0.25, 3.0], [7.0, 8.0]]), ("uint8", "<u1", [[0, 255], [128, 1], [3, 4]]), ("int8", "<i1", [[-128, 127], [0, -1], [5, 6]])])
def test_bin_files(spark, tmp_path, kind, code, values):
    path = str(tmp_path / "v.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", 3, 2) + np.array(values, code).tobytes())
    points = vector_files.read_vectors(spark, path, kind)
    assert [(r.id, r.v) for r in points.orderBy("id").collect()] == [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    out = str(tmp_path / "w.bin")
    assert vector_files.write_bin(points.repartition(3), out, kind) == (3, 2)
    assert open(out, "rb").read() == open(path, "rb").read()
    with pytest.raises(ValueError):
        vector_files.read_vectors(spark, path)


@pytest.mark.parametrize("d", [4, 2, 3])
def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch, d):
    monkeypatch.setattr(vector_files, "RANGE", 250)
    x = np.random.default_rng(0).normal(size=(101, d)).astype("<f4")
    path = str(tmp_path / "v.fbin")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *x.shape) + x.tobytes())
    got = vector_files.read_vectors(spark, path).orderBy("id").collect()
    assert [r.id for r in got] == list(range(101)) and np.array_equal(np.array([r.v for r in got], "f4"), x)


def test_vecs(spark, tmp_path):
    for name, code in (("a.fvecs", "<f4"), ("a.bvecs", "<u1")):
        x = np.arange(12).reshape(4, 3)
        with open(tmp_path / name, "wb") as f:
            for row in x:
                f.write(struct.pack("<i", 3) + row.astype(code).tobytes())
        assert [r.v for r in vector_files.read_vectors(spark, str(tmp_path / name)).orderBy("id").collect()] == x.astype(float).tolist()


def test_text_embeddings(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    open(path, "w").write("a\t1,2.5\nb\t-3,4\n")
    assert [(r.key, r.v) for r in vector_files.read_text_embeddings(spark, path).collect()] == [("a", [1.0, 2.5]), ("b", [-3.0, 4.0])]
    assert vector_files.text_to_bin(spark, path, str(tmp_path / "t.fbin")) == (2, 2)
    assert [r.v for r in vector_files.read_vectors(spark, str(tmp_path / "t.fbin")).orderBy("id").collect()] == [[1.0, 2.5], [-3.0, 4.0]]


def test_records(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in ("a.csv", "b.rec", "c.csv"))
    open(a, "w", encoding="utf-8").write('x,"y,é"\n1\n,,\n')
    assert record_files.csv_to_records(a, b) == 3
    assert [r.fields for r in record_files.read_records(spark, b).orderBy("row").collect()] == [["x", "y,é"], ["1"], ["", "", ""]]
    record_files.records_to_csv(b, c)
    assert open(c, encoding="utf-8").read() == open(a, encoding="utf-8").read()


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "v.bin")
    x = np.random.default_rng(1).integers(0, 255, (64, 8)).astype("<u1")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *x.shape) + x.tobytes())
    for extra in (["run", "-k", "4", "--csv-folder", str(tmp_path)], ["compare", "-k", "4", "-m", "3", "-r", "NaiveKmeans2"], ["init", "-c", "LSH", "-k", "4"], ["assign", "-k", "4"], ["update", "-k", "4"], ["group", "-k", "4"], ["run", "-k", "2", "-n", "10"]):
        assert cli.main([extra[0], "-i", path, *extra[1:]], spark) == 0
    assert "0 points differ" in capsys.readouterr().out
    for bad in (["-i", path, "-D", "none"], ["-t", "int4", "-i", path], []):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    with pytest.raises(ValueError):
        cli.main(["-i", path, "-f", "vec"], spark)


def test_reports(spark, toy):
    logs = bench.sweep(toy, [2, 3], ["NaiveKmeans"], init="Lazy", max_iter=2)
    wide = report.pivot(logs, ["NaiveKmeans", "PQ"]).orderBy("k").collect()
    assert [r.time_PQ for r in wide] == [-1, -1] and wide[0].msse_NaiveKmeans > 0
    it = bench.full(toy, 2).iteration_log
    assert report.average_assign(it).first()[0] > 0 and report.series(it, "msse").count() == it.count()
    report.trend(it, "msse").collect()
    report.fits(logs).collect()


def test_stream_of_points(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(60, 3))
    for part in range(3):
        rows = [(i, [float(v) for v in x[i]]) for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = Centers(x[:1])
    follow(stream, state, str(tmp_path / "check")).awaitTermination()
    assert state.counts.sum() == 60 and np.allclose(state.centers[0], x.mean(0)) and state.applied == 2
    state.update(None, 1)  # a batch that is run again is skipped
