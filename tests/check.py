"""Run queries against their SQL twins and time them.

    python tests/check.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from slicelens.plans.catalog import ORACLES, QUERIES  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    if names[0].startswith("module:"):
        names = [n for n, f in QUERIES.items() if f.__module__.endswith(names[0][7:])]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{mark} {kind:4} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
