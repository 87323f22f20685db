"""Runs of several jobs, broken off at each of them."""

import datetime as dt

import pytest
from test_warehouse import DAY1, DAY2, trade

from tapeworks.etl import JOBS
from tapeworks.plans.inputs import SCHEMAS, Inputs
from tapeworks.plans.warehouse import resumed_run
from tapeworks.runs import AFTER, RunBroken, run_jobs, run_log
from tapeworks.session import scratch_path
from tapeworks.sources.stores import ParquetStore

WANTED = ["dim_date", "dim_symbol", "dim_session", "fact_trade", "features"]


@pytest.fixture(scope="module")
def source(spark):
    store = ParquetStore(spark, scratch_path(spark, "source"))
    store.append("raw_trade", trade(
        spark, (DAY1, "09:00:00", "A", 10.0, 1.0, 10.0), (DAY1, "09:00:01", "B", 11.0, 2.0, 22.0),
        (DAY2, "09:00:00", "A", 12.0, 3.0, 36.0),
    ))
    store.append("corporation", spark.createDataFrame([("A", 1, "a", "A"), ("B", 1, "b", "B")], store.schemas["corporation"]))
    store.append("corporation_sector", spark.createDataFrame([(1, "banks")], store.schemas["corporation_sector"]))
    return store


def tables(store):
    found = {"features": "feature_data"}
    return {job: sorted(map(repr, store.read(found.get(job, job)).collect())) for job in WANTED}


@pytest.fixture(scope="module")
def undisturbed(spark, source):
    store, log = ParquetStore(spark, scratch_path(spark, "warehouse")), scratch_path(spark, "log")
    stored = run_jobs(spark, source, store, log, "day", WANTED)
    assert stored == {"dim_date": 2, "dim_symbol": 2, "dim_session": 1, "fact_trade": 3, "features": 3}
    assert {r.job: r.rows for r in run_log(spark, log).collect()} == stored
    return tables(store)


@pytest.mark.parametrize("broken", WANTED)
def test_a_broken_run_goes_on(spark, source, undisturbed, broken):
    def breaks_off(*stores):
        JOBS[broken](*stores)
        raise InterruptedError(broken)

    store, log = ParquetStore(spark, scratch_path(spark, "warehouse")), scratch_path(spark, "log")
    with pytest.raises(RunBroken) as error:
        run_jobs(spark, source, store, log, "day", WANTED, jobs=JOBS | {broken: breaks_off})
    assert set(error.value.errors) == {broken}
    finished = {r.job for r in run_log(spark, log).collect()}
    assert finished == {job for job in WANTED if job != broken and broken not in needed(job)}
    ran = run_jobs(spark, source, store, log, "day", WANTED)
    assert set(ran) == set(WANTED) - finished
    assert tables(store) == undisturbed
    assert run_jobs(spark, source, store, log, "day", WANTED) == {}


def needed(job):
    own = set(AFTER.get(job, ()))
    return own | {n for other in own for n in needed(other)}


def test_jobs_follow_what_they_need(spark, tmp_path):
    began, ended = [], []

    def job(name):
        def work(source, warehouse, **given):
            assert set(AFTER.get(name, ())) <= set(ended)
            began.append(name)
            ended.append(name)
            return len(given)
        return work

    given = {"fact_trade": {"as_of": "2025-01-06"}}
    stored = run_jobs(spark, None, None, str(tmp_path), "all", given=given, jobs={name: job(name) for name in JOBS})
    assert sorted(began) == sorted(JOBS) and stored["fact_trade"] == 1 and stored["train"] == 0
    with pytest.raises(ValueError, match="no such jobs"):
        run_jobs(spark, None, None, str(tmp_path), "other", ["nothing"])


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Three trades of a symbol that has a sector, and one of a symbol that is not known."""
    root, day = str(tmp_path_factory.mktemp("tables")), dt.datetime(2025, 1, 6)
    given = {
        "lineitem": [(n, 1, 1 + n // 4, n, 2.0, 10.0 * n, 0.1, 0.0, "R", "O", day) for n in range(1, 5)],
        "orders": [(1, 1, "O", 5.0, day, "1-URGENT")],
        "supplier": [(1, "a", 3, 0.0)],
        "nation": [(3, "banks", 1)],
    }
    for name, rows in given.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{root}/{name}.parquet")
    return Inputs(spark, root)


def failing(monkeypatch, job, attempts):
    """Let the job fail in these of its attempts, before it stores anything."""
    done, work = iter(range(1, 9)), JOBS[job]

    def fails(*stores):
        if next(done) in attempts:
            raise OSError("no space left")
        return work(*stores)

    monkeypatch.setitem(JOBS, job, fails)


def test_the_resumed_run_stores_all_facts(inputs):
    assert sorted(r.total_val for r in resumed_run(inputs).collect()) == [10.0, 20.0, 30.0]


@pytest.mark.parametrize("job, attempts", [("fact_trade", {1, 2}), ("fact_trade", {2}), ("fact_trade", {1}), ("dim_symbol", {1})])
def test_a_failure_is_no_result_of_the_resumed_run(inputs, monkeypatch, job, attempts):
    failing(monkeypatch, job, attempts)
    with pytest.raises(RunBroken) as error:
        resumed_run(inputs)
    assert {name: str(e) for name, e in error.value.errors.items()} == {job: "no space left"}
    assert error.value.__cause__ is error.value.errors[job]


@pytest.mark.parametrize("stored_before", [True, False])
def test_a_job_waits_for_what_jobs_between_need(spark, tmp_path, stored_before):
    """Features read the symbols and need the facts, which need the symbols: without new symbols there are no features."""
    ran = []

    def breaks_off(*stores):
        raise OSError("no space left")

    jobs = {job: lambda *stores, job=job: ran.append(job) or 1 for job in ("fact_trade", "features")}
    if stored_before:
        run_jobs(spark, None, None, str(tmp_path), "day", ["fact_trade"], jobs=jobs)
    wanted = ["dim_symbol", "features", *["fact_trade"][:stored_before]]
    with pytest.raises(RunBroken):
        run_jobs(spark, None, None, str(tmp_path), "day", wanted, jobs=jobs | {"dim_symbol": breaks_off})
    assert "features" not in ran
