"""python -m marlstone.cli FOLDER -p notebook -o OUT: exports a folder of notes."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .export import report, run_export, write
from .operators.render import FORMATS
from .profiles import PROFILES
from .sources.files import list_files


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="marlstone")
    a.add_argument("folder", nargs="?")
    a.add_argument("-p", "--profile", default="notebook", choices=sorted(PROFILES))
    a.add_argument("-f", "--format", choices=FORMATS)
    a.add_argument("-q", "--focus", help="a search that chooses and orders the notes")
    a.add_argument("-n", "--max-notes", type=int)
    a.add_argument("-o", "--out")
    a.add_argument("--redact", action="store_true", help="replace credentials")
    a.add_argument("--preview", action="store_true", help="count, but write nothing")
    a.add_argument("--intel", action="store_true", help="print the report; writes nothing")
    a.add_argument("--json", action="store_true", help="print the counts as JSON")
    a.add_argument("--list-profiles", action="store_true")
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_profiles:
        for p in PROFILES.values():
            print(f"{p.id:10} {p.description}")
        return 0
    if not a.folder or not (a.out or a.preview or a.intel):
        print("a folder, and -o, --preview or --intel, are needed", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    p = PROFILES[a.profile]
    p = replace(p, format=a.format or p.format, focus=a.focus, max_notes=a.max_notes, redact=a.redact or p.redact)
    b = run_export(list_files(spark, a.folder), p, a.folder.rstrip("/").rsplit("/", 1)[-1])
    written = [] if a.preview or a.intel else write(spark, b, a.out)
    if a.json:
        print(json.dumps({**b.stats, "warnings": b.warnings, "files": written}))
    elif a.intel:
        print(report(b))
    else:
        print(f"{b.stats['kept']} of {b.stats['discovered']} notes, {b.stats['parts']} parts, about {b.stats['tokens']} tokens")
        print(*b.warnings, *written, sep="\n")
    return 1 if any(w.startswith("error") for w in b.warnings) else 0


if __name__ == "__main__":
    sys.exit(main())
