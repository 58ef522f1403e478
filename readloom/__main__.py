"""python -m readloom select BAM OUT CHECK_LEADER MODE | filter SAM LIST OUT"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from .plans import run

    if args[:1] == ["select"] and len(args) == 5:
        spark = SparkSession.builder.appName("readloom").getOrCreate()
        found = run.select_duplicates(spark, args[1], args[2], bool(int(args[3])), int(args[4]))
        for warning in found["warnings"]:
            print(warning, file=sys.stderr)
        print(found["list"])
        found["report"].show(200, truncate=False)
    elif args[:1] == ["filter"] and len(args) == 4:
        seen = run.filter_sam(SparkSession.builder.appName("readloom").getOrCreate(), *args[1:])
        print("{headers} headers, {alignments} alignments, {skipped} lines of too few fields skipped".format(**seen), file=sys.stderr)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
