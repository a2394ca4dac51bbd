"""Run registered queries against DuckDB: python tests/run_checks.py [sf] [name part ...]."""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from comarca.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            note = compare(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as error:
            note = "".join(traceback.format_exception(error))[-1500:]
        ok = note is None or note.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("bad:", bad)
