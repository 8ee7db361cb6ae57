"""Command line: check or load a folder of star-table CSV files.

    python -m mercato validate <folder>            report problems per file (first 5 shown)
    python -m mercato load <folder> <out> [--strict] typed Parquet per table, rejects beside it
"""

from __future__ import annotations

import argparse
import os
import sys

from mercato.schema import LOAD_ORDER
from mercato.session import build_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m mercato")
    sub = ap.add_subparsers(dest="cmd", required=True)
    v = sub.add_parser("validate", help="check the CSV files of a folder")
    v.add_argument("folder")
    ld = sub.add_parser("load", help="load the CSV files of a folder into typed Parquet")
    ld.add_argument("folder")
    ld.add_argument("out")
    ld.add_argument("--strict", action="store_true", help="apply every entity rule")
    ap.add_argument("--master", default=None, help="Spark master (default: the environment's)")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from mercato.operators import quality

    owned = SparkSession.getActiveSession() is None
    spark = build_session(args.master)
    try:
        if args.cmd == "validate":
            _, summary = quality.validate_folder(spark, args.folder)
            rows = summary.orderBy("table").collect()
            for r in rows:
                state = "missing" if r.missing else ("ok" if r.problems == 0 else f"{r.problems} problems")
                print(f"{r.table}: {state}")
                for p in (r.first_problems or []):
                    print(f"    key={p.key} column={p.column} value={p.value!r} rule={p.rule}")
            total = rows[0].total_problems if rows else 0
            print(f"files read: {rows[0].files_read if rows else 0} of {len(rows)}; problems: {total}")
            return 0 if total == 0 else 1
        level = "strict" if args.strict else "conform"
        for table in LOAD_ORDER:
            path = os.path.join(args.folder, f"{table}.csv")
            if not os.path.exists(path):
                print(f"{table}: no file")
                continue
            try:
                res = quality.load_csv_table(spark, path, table, os.path.join(args.out, table), level=level)
            except quality.TooManyErrors as e:
                print(f"{table}: stopped, {e}")
                return 2
            print(f"{table}: {res['rows']} rows, {res['rejected']} rejected")
        return 0
    finally:
        if owned:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
