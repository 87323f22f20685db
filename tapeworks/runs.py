"""Runs of several jobs in the order of their dependencies, with a log from which a broken run goes on.

The log is a folder with one small file for each finished job of a run, written after the job has stored its rows.
A run that broke off is started again under its name: jobs in the log are left out, the others run (again), which
every job allows. One process at a time works on a run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from tapeworks.etl import JOBS
from tapeworks.session import path_exists
from tapeworks.sources.stores import Store
from tapeworks.sources.versions import publish

_CALENDAR = ("dim_date", "dim_time", "dim_exchange", "dim_session")
#: What each job reads that other jobs write.
AFTER: dict[str, tuple[str, ...]] = {
    "fact_trade": (*_CALENDAR, "dim_symbol"),
    "fact_quote": (*_CALENDAR, "dim_symbol"),
    "fact_market_index": (*_CALENDAR, "dim_index"),
    "features": ("fact_trade",),
    "train": ("daily_features",),
}
LOG_SCHEMA = "run string, job string, rows bigint, started double, seconds double"


class RunBroken(Exception):
    """Some jobs failed; ``errors`` has the error of each. Jobs that need them were not started."""

    def __init__(self, run: str, errors: dict[str, BaseException]):
        super().__init__(f"{run}: " + "; ".join(f"{job}: {error}" for job, error in sorted(errors.items())))
        self.errors = errors


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Finished jobs of all runs: rows stored by the attempt that finished, start and seconds."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).json(path)


def run_jobs(
    spark: SparkSession, source: Store, warehouse: Store, log: str, run: str, wanted: Collection[str] | None = None,
    given: Mapping[str, dict] | None = None, side_by_side: int = 4, jobs: Mapping[str, Callable[..., int]] = JOBS,
    after: Mapping[str, Collection[str]] = AFTER,
) -> dict[str, int]:
    """Run the ``wanted`` jobs (all by default) that ``run`` has not finished; returns the rows each one stored.

    Jobs that do not depend on each other run ``side_by_side``. ``given`` holds arguments of single jobs, such as
    ``{"fact_trade": {"as_of": "2025-01-06"}}``. Needed jobs that are not wanted count as done, but what they need in turn
    still comes first. If jobs fail, those that don't need them still run before ``RunBroken`` is raised.
    """
    names = set(jobs if wanted is None else wanted)
    if unknown := names - set(jobs):
        raise ValueError(f"no such jobs: {sorted(unknown)}")
    folder = f"{log}/run={run}"
    finished = {r["job"] for r in run_log(spark, folder).select("job").collect()}  # one row a job
    left = names - finished

    def needs(job: str) -> set[str]:
        return {found for n in after.get(job, ()) for found in ({n} if n in left else needs(n))}

    order = TopologicalSorter({job: needs(job) for job in sorted(left)})
    order.prepare()

    def attempt(job: str) -> int:
        started = time.time()
        stored = jobs[job](source, warehouse, **(given or {}).get(job, {}))
        entry = {"run": run, "job": job, "rows": stored, "started": started, "seconds": time.time() - started}
        publish(spark, folder, f"{job}.json", json.dumps(entry))
        return stored

    rows: dict[str, int] = {}
    errors: dict[str, BaseException] = {}
    with ThreadPoolExecutor(side_by_side) as pool:
        working: dict[Future[int], str] = {}
        while True:
            working |= {pool.submit(attempt, job): job for job in order.get_ready()}
            if not working:
                break
            for ended in wait(working, return_when=FIRST_COMPLETED).done:
                job = working.pop(ended)
                if (error := ended.exception()) is not None:
                    errors[job] = error
                else:
                    rows[job] = ended.result()
                    order.done(job)
    if errors:
        raise RunBroken(run, errors) from next(iter(errors.values()))
    return rows
