"""python -m tidemark list | run QUERY SF_DIR [--out PATH] | explain QUERY SF_DIR"""

from __future__ import annotations

import argparse

from tidemark import catalog
from tidemark.plans import all_queries  # noqa: F401


def main() -> None:
    p = argparse.ArgumentParser(prog="tidemark")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    for verb in ("run", "explain"):
        v = verbs.add_parser(verb)
        v.add_argument("query", choices=sorted(catalog.queries()))
        v.add_argument("sf_dir")
        if verb == "run":
            v.add_argument("--out")
    a = p.parse_args()
    if a.verb == "list":
        sql = catalog.oracle_sql()
        print("\n".join(f"{n}{'' if n in sql else ' (no SQL twin)'}" for n in sorted(catalog.queries())))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = catalog.queries()[a.query](spark, a.sf_dir)
    if a.verb == "explain":
        df.explain("formatted")
    elif a.out:
        from tidemark.sources.sinks import write_atomic

        write_atomic(df, a.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
