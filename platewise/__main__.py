"""Command line: ``python -m platewise <step> <input folder> <output folder>``.

Steps: ``check`` and ``parse`` read spreadsheet exports and end with 1 if a file is unfit; ``analyze`` reads parsed
wells; ``charts`` and ``report`` read the same wells and add to the tables that ``analyze`` published.
Each step publishes its tables together and prints where they are.
"""

from __future__ import annotations

import argparse

from platewise.plans import jobs
from platewise.session import build_session
from platewise.sources.publishing import table_path
from platewise.sources.tables import load_parsed_files, load_wells


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="platewise", description=__doc__)
    parser.add_argument("step", choices=["check", "parse", "analyze", "charts", "report"])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "csv-files"], help="format of result tables; csv-files gives small ones as one file each")
    parser.add_argument(
        "--input-format",
        default="parquet",
        choices=["parquet", "csv", "parsed-csv"],
        help="wells as written by parse, or a folder of *_parsed.csv files",
    )
    parser.add_argument("--types", nargs="*", default=None, help="analyze: sample types for the wide comparison of runs")
    args = parser.parse_args(argv)
    spark = build_session(f"platewise {args.step}")
    if args.step == "check":
        report = jobs.check(spark, args.input, args.output)["structure_report"]
        return 0 if report.filter("not passed").isEmpty() else 1
    if args.step == "parse":
        _, all_used = jobs.parse(spark, args.input, args.output, args.format)
        return 0 if all_used else 1
    if args.input_format == "parsed-csv":
        wells = load_parsed_files(spark, args.input)
    else:
        wells = load_wells(spark, args.input, args.input_format)
    step = {
        "analyze": jobs.write_outputs,
        "charts": jobs.write_chart_tables,
        "report": jobs.write_report_tables,
    }[args.step]
    more = {"types": args.types} if args.step == "analyze" and args.types else {}
    for name in step(spark, wells, args.output, args.format, **more):
        print(name, table_path(spark, args.output, name)[0], sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
