"""Run registered queries against their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.registry import CHECKS, oracle, spark_query
from checks.views import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def compare(spark, con, sf_dir: str, key: str) -> tuple[bool, str]:
    names = sorted(n for n, _ in CHECKS[key].cols)
    began = time.time()
    got = Counter(
        tuple(_norm(r[n]) for n in names) for r in spark_query(key)(spark, sf_dir).collect()
    )
    spent = time.time() - began
    sql = oracle(key)
    if sql is None:
        return True, f"rows {sum(got.values())} (no SQL) {spent:.1f}s"
    want = Counter(
        tuple(_norm(v) for v in r)
        for r in con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    )
    note = f"rows {sum(got.values())}/{sum(want.values())} {spent:.1f}s"
    if got == want and sum(want.values()):
        return True, note
    missing, extra = want - got, got - want
    return False, f"{note}\n   {names}\n   sql only   {list(missing)[:3]}\n   spark only {list(extra)[:3]}"


def main(argv: list[str]) -> int:
    import checks.all  # noqa: F401
    from scorelake.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir = argv.pop(0)
    keys = [k for k in CHECKS if not argv or argv[0].endswith(".py") or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    if argv and argv[0].endswith(".py"):
        module = f"checks.{argv.pop(0)[:-3]}"
        keys = [k for k in CHECKS if CHECKS[k].run.__module__ == module]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for key in keys:
        try:
            ok, note = compare(spark, con, sf_dir, key)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(keys) - len(bad)} of {len(keys)} match; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
