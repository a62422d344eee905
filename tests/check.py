"""Run registered queries against their oracle: python tests/check.py [names...]."""

from __future__ import annotations

import glob
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(df, con, sql: str) -> str:
    """'' when both sides have the same columns, types and rows in any order."""
    names = sorted(df.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    result = con.execute(sql)
    want_kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(want_kinds) != names:
        return f"columns {names} <> {sorted(want_kinds)}"
    order = [list(want_kinds).index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    wrong = {n: (kinds[n], want_kinds[n]) for n in names if kinds[n] != want_kinds[n]}
    note = f"types {wrong} " if wrong else ""
    if got == want:
        return note if wrong else ""
    left, right = set(got) - set(want), set(want) - set(got)
    return (
        f"{note}rows {len(got)} <> {len(want)}; only spark {len(left)}: {sorted(left, key=repr)[:2]}; "
        f"only oracle {len(right)}: {sorted(right, key=repr)[:2]}"
    )


def _stop(*_: object) -> None:
    raise TimeoutError("over time")


def main() -> int:
    signal.signal(signal.SIGALRM, _stop)
    import __spark_entry__ as entry
    from palisade.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        start = time.time()
        signal.alarm(int(os.environ.get("CHECK_SECONDS", "90")))
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                text = compare(df, con, oracles[name]) or f"ok {con.execute('select count(*) from (' + oracles[name] + ')').fetchone()[0]} rows"
            else:
                text = f"rows only {df.count()}"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__} {str(error)[:700]}"
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad = not text.startswith(("ok", "rows only"))
        failed += bad
        print(f"{'BAD ' if bad else ''}{name} [{time.time() - start:.1f}s] {text}", flush=True)
    print(f"{failed} of {len(sys.argv[1:] or queries)} bad")
    return failed


if __name__ == "__main__":
    sys.exit(main())
