"""The jobs on small folders that grow, on awkward rows, and against DuckDB on the given tables."""

import datetime as dt
import json
import math
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import log_literals, probe_monitor
from jobs import queries as jobs
from jobs.common import settings

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def files(path):
    """Every data file below a folder, and when it was written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# ------------------------------------------------------------------ log literals

LOGS = [
    (1, "dt = 0.5 steps 100 verbose true", "s/1", "en"),
    (2, None, None, "en"),
    (3, "  \t ", "", None),
    (4, "[1,2] +7 -1e3 .5 5. 1.2.3 -x +", "a b", "de"),
    (4, "[1,2] +7 -1e3 .5 5. 1.2.3 -x +", "a b", "de"),
    (5, "YES No maybe 99999999999999999999", "s/1", "en"),
    (None, "1 " * 30000, "big", "en"),
]
EXPECTED = {
    1: (7, 1, 1, 1, 0, 0.5, 100.0, True, "s_1"),
    2: (0, 0, 0, 0, 0, None, None, True, "none"),
    3: (0, 0, 0, 0, 0, None, None, True, "_"),
    4: (8, 0, 1, 3, 1, -1000.0, 7.0, True, "a_b"),
    5: (4, 2, 1, 0, 0, 1e20, 1e20, False, "s_1"),
    None: (30000, 0, 30000, 0, 0, 1.0, 1.0, True, "big"),
}


def logs(spark, rows, path, mode="overwrite"):
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.mode(mode).parquet(path)


def shown(df):
    return sorted(((r.doc_id, (r.n_words, r.n_bool, r.n_int, r.n_float, r.n_array, r.least, r.greatest, r.in_range, r.origin)) for r in df.collect()), key=str)


def test_literals_of_awkward_logs(spark, tmp_path):
    logs(spark, LOGS, f"{tmp_path}/in")
    out = log_literals.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", **{"limits.high": 1e6})
    want = sorted([(k, v) for k, v in EXPECTED.items()] + [(4, EXPECTED[4])], key=str)
    assert shown(out) == want
    assert {f for f in os.listdir(f"{tmp_path}/out") if "=" in f} == {"origin=s_1", "origin=none", "origin=_", "origin=a_b", "origin=big"}
    assert shown(log_literals.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", **{"limits.high": 1e6})) == want


def test_a_run_on_one_source_leaves_the_others(spark, tmp_path):
    logs(spark, LOGS, f"{tmp_path}/in")
    log_literals.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", **{"limits.high": 1e6})
    before = files(f"{tmp_path}/out/origin=a_b")
    logs(spark, [(9, "3", "s/1", "en")], f"{tmp_path}/one")
    out = log_literals.run(spark, f"{tmp_path}/one", f"{tmp_path}/out")
    assert [k for k, _ in shown(out.where("origin = 's_1'"))] == [9]
    assert files(f"{tmp_path}/out/origin=a_b") == before


def test_no_logs(spark, tmp_path):
    logs(spark, [], f"{tmp_path}/in")
    assert log_literals.run(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 0


# ----------------------------------------------------------------- probe monitor


def reading(k, day, value, field="u", probe=1):
    ts = None if day is None else dt.datetime(2024, 1, day, 12)
    return (k, ts, probe, field, value)


def drop(spark, rows, folder):
    spark.createDataFrame(rows, probe_monitor.READINGS).coalesce(1).write.mode("append").parquet(folder)


LIMITS = {"limits.low": 0.0, "limits.high": 10.0, "limits.rms": 2.0, "time.dt": 0.1}


def monitor(spark, tmp_path, out="out", **given):
    df = probe_monitor.run(spark, f"{tmp_path}/in", f"{tmp_path}/{out}", f"{tmp_path}/{out}-mark", **(LIMITS | given))
    return {(r.day, r.field): (r.n, r.mean, r.rms, r.least, r.greatest, r.status) for r in df.collect()}


def test_growing_input_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level("INFO", "jobs")
    drop(spark, [reading(1, 1, 1.0), reading(2, 1, 3.0), reading(3, 2, 1.0)], f"{tmp_path}/in")
    first = monitor(spark, tmp_path)
    assert first == {("2024-01-01", "u"): (2, 2.0, round(math.sqrt(5), 6), 1.0, 3.0, "Stable"), ("2024-01-02", "u"): (1, 1.0, 1.0, 1.0, 1.0, "Stable")}
    untouched = files(f"{tmp_path}/out/report/day=2024-01-01")
    drop(spark, [reading(4, 2, 11.0), reading(5, 3, float("nan")), reading(6, 3, 2.0, "v")], f"{tmp_path}/in")
    second = monitor(spark, tmp_path)
    assert second[("2024-01-01", "u")] == first[("2024-01-01", "u")]
    assert files(f"{tmp_path}/out/report/day=2024-01-01") == untouched
    assert second[("2024-01-02", "u")] == (2, 6.0, round(math.sqrt(61), 6), 1.0, 11.0, "Unstable")
    assert second[("2024-01-03", "u")][5] == "Critical" and second[("2024-01-03", "v")][5] == "Stable"
    read = [r.getMessage() for r in caplog.records if "new readings" in r.getMessage()]
    assert [m.split(", ")[1].split()[0] for m in read] == ["3", "3"]
    # late readings renew their day, whichever run brings them
    drop(spark, [reading(7, 1, 2.0)], f"{tmp_path}/in")
    assert monitor(spark, tmp_path)[("2024-01-01", "u")][0] == 3
    # one run over everything gives the same report
    assert str(sorted(monitor(spark, tmp_path, "whole").items())) == str(sorted(monitor(spark, tmp_path).items()))


def test_rerun_without_new_files_writes_nothing(spark, tmp_path):
    drop(spark, [reading(1, 1, 1.0)], f"{tmp_path}/in")
    first = monitor(spark, tmp_path)
    before = files(f"{tmp_path}/out/partials") | files(f"{tmp_path}/out/report/day=2024-01-01")
    assert monitor(spark, tmp_path) == first
    assert files(f"{tmp_path}/out/partials") | files(f"{tmp_path}/out/report/day=2024-01-01") == before


def test_batches_of_files_and_a_batch_that_runs_again(spark, tmp_path):
    for k in range(5):
        drop(spark, [reading(10 * k + j, 1 + j % 2, float(k + j)) for j in range(4)], f"{tmp_path}/in")
    want = monitor(spark, tmp_path)
    assert monitor(spark, tmp_path, "small", **{"stream.files": 2}) == want
    assert len([d for d in os.listdir(f"{tmp_path}/small/partials") if "=" in d]) == 3
    # as after a failure between the batch's writes and its commit
    commits = f"{tmp_path}/small-mark/commits"
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    assert monitor(spark, tmp_path, "small", **{"stream.files": 2}) == want


def test_nulls_and_no_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    assert monitor(spark, tmp_path) == {}
    drop(spark, [reading(1, None, 1.0), reading(2, 1, None, None), (None, None, None, None, None)], f"{tmp_path}/in")
    assert monitor(spark, tmp_path) == {("none", "u"): (1, 1.0, 1.0, 1.0, 1.0, "Stable"), ("2024-01-01", "none"): (1, None, None, None, None, "Stable"), ("none", "none"): (1, None, None, None, None, "Stable")}


# -------------------------------------------------------------------- settings


def test_settings(spark, tmp_path):
    for name, job in (("log_literals", log_literals), ("probe_monitor", probe_monitor)):
        shipped = settings(spark, job.SCHEMA, f"{REPO}/jobs/{name}.json")
        assert set(shipped) == {k for k, *_ in job.SCHEMA}
    (tmp_path / "bad.json").write_text(json.dumps({"stream": {"files": 0}, "limits": {"rms": "wide"}, "colour": 1}))
    with pytest.raises(ValueError, match="colour: unknown, limits.rms: type, stream.files: rule"):
        settings(spark, probe_monitor.SCHEMA, f"{tmp_path}/bad.json")
    assert settings(spark, log_literals.SCHEMA, None)["output.digits"] == 6


def test_command_line(tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    command = [sys.executable, "-m", "jobs.log_literals", "--input", f"{SF}/documents.parquet", "--output", f"{tmp_path}/out", "--config", f"{REPO}/jobs/log_literals.json"]
    done = subprocess.run(command, cwd=REPO, env=os.environ | {"SPARK_MASTER": "local[2]"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 logs" in done.stderr and files(f"{tmp_path}/out")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_registered(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.execute(jobs.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = jobs.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows), key=str)
    have = plain(tuple(r[c] for c in names) for r in got.collect())
    assert have and have == plain(want.fetchall())
