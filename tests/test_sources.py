import pytest

from lattica import experiment
from lattica.sources import csv
from lattica.sources.results import SCHEMA, ResultsTable, RunResult
from tests.fixtures import READINGS, VOYAGES, brute_minimal, cells


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readings(spark, tmp_path):
    path = put(tmp_path / "readings.csv", READINGS)
    df = csv.read_csv(spark, path)
    assert df.columns == ["Probe", "Level"] and [tuple(r) for r in df.collect()] == cells(READINGS)
    bare = csv.CsvLoader.of(path).with_header(False).with_delimiter(",").load(spark)
    assert bare.columns == ["col_1", "col_2"] and bare.count() == 5 and bare.first()[0] == "Probe"
    assert csv.row_count(spark, path) == 4 and csv.column_count(spark, path) == 2 and csv.shape(df) == (4, 2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        csv.read_csv(spark, str(tmp_path / "missing.csv"))


def test_dialect(spark, tmp_path):
    path = put(tmp_path / "d.csv", 'a;b;c\n"x;y"; padded ;\n;"  in ";ü|ö\n')
    assert csv.detect_delimiter(spark, path) == ";"
    assert [tuple(r) for r in csv.read_csv(spark, path).collect()] == [("x;y", "padded", ""), ("", "in", "ü|ö")]
    assert csv.tokenize('a,"b,c", d ,""') == ["a", "b,c", "d", ""]
    assert csv.detect_delimiter(spark, put(tmp_path / "t.csv", "a\tb\tc\n")) == "\t"
    assert csv.detect_delimiter(spark, put(tmp_path / "e.csv", "a,b;c\n")) == ","
    assert csv.read_csv(spark, path, columns=["c"]).columns == ["c"]
    ragged = put(tmp_path / "r.csv", "a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_csv(spark, ragged).collect()


def test_tables(spark, tmp_path):
    assert csv.table_of(spark, ["a", "b"], [(1, None)]).collect()[0] == ("1", "")
    with pytest.raises(ValueError):
        csv.table_of(spark, ["a", "b"], [(1,)])
    assert csv.typed_table(spark, [("i", "integer"), ("d", "DOUBLE"), ("b", "boolean")], [(1, 2.0, True)]).first() == (1, 2.0, True)
    with pytest.raises(Exception, match="(?i)type"):
        csv.typed_table(spark, [("i", "INTEGER")], [("x",)])
    put(tmp_path / "wide.csv", "a,b,c\n1,2,3\n")
    put(tmp_path / "thin.csv", "a\n1\n")
    assert [(p.rsplit("/", 1)[1], n) for p, n in csv.datasets_by_width(spark, str(tmp_path))] == [("thin.csv", 1), ("wide.csv", 3)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_results(spark, tmp_path, fmt):
    path = str(tmp_path / "results")
    out = ResultsTable(spark, path, fmt=fmt)
    assert not out.has("a,b", "G3-No-Sampling", "levelwise")
    out.write(RunResult("a,b", "G3-No-Sampling", "levelwise", fd_count=4, stats="x, y"))
    out.write_error("a,b", "G3-No-Sampling", "bestfirst", "no, luck\nat all")
    assert out.read().columns == [f.name for f in SCHEMA] and len(SCHEMA) == 13
    assert out.has("a,b", "G3-No-Sampling", "levelwise") and not out.has("a,b", "G3-No-Sampling", "bestfirst")
    assert sorted(r["Status"] for r in out.read().collect()) == ["FAILURE", "SUCCESS"]
    again = ResultsTable(spark, path, "OVERWRITE", fmt)
    assert again.backup and again.read().count() == 0
    with pytest.raises(ValueError):
        ResultsTable(spark, path, "REPLACE")


def test_runs(spark, tmp_path):
    path = put(tmp_path / "voyages.csv", VOYAGES)
    out = ResultsTable(spark, str(tmp_path / "out"))
    row, found = experiment.run_one(csv.read_csv(spark, path), path, "tane", "FOCUSED", out, max_error=0.05)
    assert row.status == "SUCCESS" and row.fd_count == len(brute_minimal(cells(VOYAGES), 6, 0.05, 0)) and row.config == "G3-No-Sampling" and "NO_SAMPLING" in row.stats
    plan = experiment.run_suite(spark, [path], out, dry_run=True)
    assert len(plan) == 5 and {r.algorithm for r in plan} == {"levelwise", "bestfirst"}
    stats = {}
    for mode in experiment.CONFIGS:
        run, _ = experiment.run_one(csv.read_csv(spark, path).select("port", "berth", "cargo"), path, "pyro", mode, max_error=0.05, sample_param=0.6, max_lhs=1)
        assert run.status == "SUCCESS" and run.config == experiment.CONFIGS[mode] and run.memory_mb > 0, run.message
        stats[mode] = run.stats
    assert "estimated" in stats["RANDOM"] and len({s.rsplit("mean estimate", 1)[1] for s in stats.values()}) > 1  # each mode has its own estimates
    slow, _ = experiment.run_one(csv.read_csv(spark, path), path, "levelwise", timeout=1e-5)
    assert slow.status == "TIMEOUT"
    with pytest.raises(ValueError):
        experiment.configured("best", "NO_SAMPLING")
    with pytest.raises(SystemExit):
        experiment.main(["--dataset", path])
    args = ["--dataset", path, "--results-file", str(tmp_path / "cli"), "--algorithm", "bestfirst", "--sampling-mode", "RANDOM", "--run-mode", "APPEND", "--max-lhs", "1"]
    assert experiment.main(args) == 0


def test_memory_monitor(spark):
    seen = []
    m = experiment.MemoryMonitor(spark, 0.01, lambda level, share: seen.append(level))
    m.WARNING, m.CRITICAL = 0.0, 2.0
    with m:
        spark.range(1000).count()
    assert m.peak_mb > 0 and 0 < len(m.history) <= 10 and seen == ["warning"]
    m.CRITICAL = 0.0
    m.look()
    assert seen == ["warning", "critical"] and m.level == "critical"


def test_stream(spark, tmp_path):
    from lattica.operators.measures import errors
    from lattica.streaming.incremental import watch

    df = spark.createDataFrame([(i % 5, i % 3) for i in range(60)], "x int, y int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watch(stream, ["x"], "y", lambda batch, r: seen.append(r), checkpointLocation=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) >= 2 and seen[-1] == errors(df, ["x"], "y").first().asDict()
