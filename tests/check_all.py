"""Compare every query with its SQL at one scale: python tests/check_all.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from lexigrid.session import local_session  # noqa: E402
from tests.harness import compare, duck  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(cpus=8, memory="8g")
    con, queries, checks = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toArrow()
            took = time.time() - start
            start = time.time()
            if name in checks:
                want = con.sql(checks[name]).to_arrow_table()
                note = compare(got, want) or "ok"
            else:
                note = "no SQL"
            if "OBJECT" in str(got.schema).upper():
                note = "schema"
        except Exception as error:  # one broken query must not hide the others
            note, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
            got = None
        bad += note not in ("ok", "no SQL")
        rows = got.num_rows if got is not None else -1
        print(f"{name:28s} {rows:8d} rows {took:6.2f} s  SQL {time.time() - start:5.2f} s  {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
