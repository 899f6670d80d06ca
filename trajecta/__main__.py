"""Run the stages from the command line, e.g. ``spark-submit`` or ``python -m trajecta``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trajecta.config import Settings
from trajecta.plans import stages
from trajecta.sources.provenance import read_declared
from trajecta.sources.register import read_code_list, read_register
from trajecta.sources.store import TableStore

STAGES = ("sources", "all", "national", "trajectories", "archetypes", "geography", "verify", "report")


def main() -> None:
    parser = argparse.ArgumentParser(prog="trajecta", description=__doc__)
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--register", help="register in Parquet")
    parser.add_argument("--codes", help="territory code list in CSV")
    parser.add_argument("--out", help="folder of the exported tables")
    parser.add_argument("--manifest", help="manifest the sources are checked against, or that sources writes")
    parser.add_argument("--declared", help="CSV of declared sources: nom, millesime, url, fichier, date_telechargement")
    parser.add_argument("--folder", help="folder of the landed source files")
    parser.add_argument("--landing", help="folder for a copy of the register by level")
    parser.add_argument("--vintage", type=int, default=Settings.vintage)
    parser.add_argument("--threshold", type=int, default=Settings.threshold)
    args = parser.parse_args()
    needed = {
        "sources": ("declared", "folder", "manifest"), "all": ("register", "codes", "out"), "national": ("register", "out"),
        "geography": ("register", "codes", "out"), "verify": ("register", "out"),
    }.get(args.stage, ("out",))
    if lacking := [f"--{name}" for name in needed if not getattr(args, name)]:
        parser.error(f"{args.stage} needs {', '.join(lacking)}")

    spark = SparkSession.builder.appName(f"trajecta {args.stage}").getOrCreate()
    settings = Settings(vintage=args.vintage, threshold=args.threshold)
    if args.stage == "sources":
        declared = read_declared(spark, args.declared)
        written = stages.run_sources(spark, declared, args.folder, args.manifest)
        print("manifest written" if written else "nothing changed")
        return
    store = TableStore(spark, args.out)
    # Each stage that reads a source checks it first; "all" does so itself.
    reads = {"national": {"prenoms": args.register}, "geography": {"prenoms": args.register, "departements": args.codes}}
    if args.manifest and args.stage in reads:
        stages.check_sources(spark, args.manifest, **reads[args.stage])
    if args.stage == "all":
        rows = stages.run(
            spark, args.register, args.codes, args.out, settings, args.manifest, args.landing
        )
    elif args.stage == "national":
        rows = stages.run_national(store, read_register(spark, args.register))
    elif args.stage == "trajectories":
        rows = stages.run_trajectories(store, settings)
    elif args.stage == "archetypes":
        rows = stages.run_archetypes(store, settings)
    elif args.stage == "geography":
        register, codes = read_register(spark, args.register), read_code_list(spark, args.codes)
        rows = stages.run_geography(store, register, codes)
    elif args.stage == "verify":
        stages.verify(store, read_register(spark, args.register), settings).show(100, False)
        return
    else:
        reports = [
            stages.trajectory_report(store, settings),
            stages.archetype_report(store, settings),
            stages.geography_report(store),
        ]
        for report in reports:
            for name, df in report.items():
                print(name)
                df.show(50, False)
        return
    for table, count in rows.items():
        print(f"{table:<18} {count:>12,}")


if __name__ == "__main__":
    main()
