"""Command line: python -m corollary.cli COMMAND ...

query RULES GOAL [NAME=CSV ...]      rules (a file or text) over CSV relations, rows of the goal
magic RULES NAME ADORNMENT VALUE... [NAME=CSV ...]
check RULES                          diagnostics
lookup|prefix|rank|count|select NAME=CSV VALUE...
pattern NAME=CSV COLUMN REGEX
traverse EDGES.csv START [DEPTH]     breadth first
search OBSERVATION.csv TERM...       all terms
project init|check|build|query FOLDER [GOAL]
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .lang.ast import RuleError
from .session import Database
from .sources.project import Project
from .sources.typed import LoadError


def _value(text: str) -> int | str:
    return int(text) if text.isascii() and text.isdigit() else text


def _print(df) -> None:
    for r in df.orderBy(*df.columns).toLocalIterator():
        print(",".join("null" if x is None else str(x) for x in r))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if args else 2
    spark = spark or SparkSession.builder.appName("corollary").getOrCreate()
    command, rest = args[0], args[1:]
    tables = [a.split("=", 1) for a in rest if "=" in a and Path(a.split("=", 1)[1]).exists()]
    rest = [a for a in rest if "=" not in a or not Path(a.split("=", 1)[1]).exists()]
    db = Database(spark)
    try:
        for name, path in tables:
            db.load_csv(name, path)
        if command == "project":
            verb, folder = rest[0], rest[1]
            if verb == "init":
                Project.init(folder)
            elif verb == "check":
                Project(spark, folder).check()
            elif verb == "build":
                print(Project(spark, folder).build())
            elif verb == "query":
                print("\n".join(Project(spark, folder).lines(rest[2])))
            else:
                raise ValueError(f"unknown command project {verb}")
        elif command in ("query", "magic", "check"):
            text = Path(rest[0]).read_text() if Path(rest[0]).is_file() else rest[0]
            if command == "check":
                found = db.check(text)
                print("\n".join(found))
                return int(bool(found))
            for remark in db.load_rules(text):
                print(remark, file=sys.stderr)
            _print(db.query(rest[1]) if command == "query" else db.query_magic(rest[1], rest[2], *map(_value, rest[3:])))
        elif command in ("lookup", "rank", "select", "count"):
            got = getattr(db, command)(tables[0][0], *map(_value, rest))
            print(int(got) if isinstance(got, bool) else ",".join(map(str, got)) if isinstance(got, tuple) else got)
        elif command == "prefix":
            _print(db.prefix(tables[0][0], *map(_value, rest)))
        elif command == "pattern":
            _print(db.pattern(tables[0][0], int(rest[0]), rest[1]))
        elif command == "traverse":
            db.load_csv("edge", rest[0])
            _print(db.traverse(_value(rest[1]), *map(int, rest[2:3])))
        elif command == "search":
            db.load_csv("observation", rest[0])
            db.build_index()
            _print(db.search(" ".join(rest[1:])))
        else:
            raise ValueError(f"unknown command {command}")
    except (RuleError, LoadError, ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
