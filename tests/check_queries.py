"""Run queries beside their oracles: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time

sys.path[:0] = [str(pathlib.Path(__file__).parents[1]), str(pathlib.Path(__file__).parent)]

from compare import connect, differences  # noqa: E402
from tapeworks.plans import CATALOG  # noqa: E402
from tapeworks.session import build_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(sf_dir), 0
    for name in names or CATALOG:
        start = time.time()
        try:
            df = CATALOG[name].run(spark, sf_dir)
            sql = CATALOG[name].sql
            found = differences(df, connection, sql) if sql else []
            note = f"{df.count()} rows" if not sql else ("ok" if not found else "DIFFERS")
        except Exception as error:
            found, note = [str(error)[:1500]], "FAILED"
        bad += bool(found)
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", *found, sep="\n    " if found else " ", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
