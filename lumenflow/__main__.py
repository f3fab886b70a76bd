"""python -m lumenflow list | explain QUERY FOLDER | run QUERY FOLDER [--out PATH] [--format parquet|json|csv] [--cpus N]"""

from __future__ import annotations

import argparse

from lumenflow.queries import QUERIES
from lumenflow.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenflow", description="Run a registered query over a folder of Parquet tables.")
    parser.add_argument("action", choices=["list", "explain", "run"])
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    parser.add_argument("--cpus", default="*")
    args = parser.parse_args(argv)
    if args.action == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.query not in QUERIES or not args.folder:
        parser.error("name a query (see list) and a folder of tables")
    df = QUERIES[args.query](local_session(args.cpus), args.folder)
    if args.action == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").option("header", True).format(args.format).save(args.out)
    else:
        df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
