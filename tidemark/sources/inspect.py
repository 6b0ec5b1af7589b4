"""``python -m tidemark.sources.inspect --data DIR DAY/PART``: what a part holds, as text. Reads only.

Ends with 0, with 1 if there is no such part, and with 2 if the call is wrong.
"""

from __future__ import annotations

import re
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from ..plans.database import Database


def show(db: Database, day: str, part_id: str, series: int | None = None, samples: bool = False, limit: int = 20, out: TextIO = sys.stdout) -> int:
    """Prints the part; 1 if there is none of that name."""
    try:
        for line in db.inspect_lines(day, part_id, series, samples, limit):
            print(line, file=out)
    except KeyError as error:
        print(error.args[0], file=sys.stderr)
        return 1
    return 0


def main(args: list[str] | None = None, out: TextIO = sys.stdout, spark: SparkSession | None = None) -> int:
    import argparse

    own = argparse.ArgumentParser(prog="inspect")
    own.add_argument("part", help="YYYYMMDD/NNNNNN")
    own.add_argument("--data", default="tidemark-data")
    own.add_argument("--series", type=int, default=0, help="only the series with this number")
    own.add_argument("--samples", action="store_true", help="samples instead of the first and the last")
    own.add_argument("--limit", type=int, default=20, help="samples to show of each series, 0 for all")
    try:
        given = own.parse_args(args)
    except SystemExit as end:
        return int(end.code or 0)
    if not (m := re.fullmatch(r"(\d{8})/(\d{6})", given.part)):
        print("the part must be named as YYYYMMDD/NNNNNN", file=sys.stderr)
        return 2
    db = Database(spark or SparkSession.builder.getOrCreate(), given.data)
    return show(db, m[1], m[2], given.series or None, given.samples, given.limit, out)


if __name__ == "__main__":
    sys.exit(main())
