"""Stages of a linkage run: ``python -m kinfold <stage> --data FOLDER --work FOLDER``. A stage makes those it needs, and one that is there isn't made again."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import decide, evaluate, sampling, validate
from kinfold.plans import linkage
from kinfold.sources import tsv
from kinfold.sources.store import Store

#: Stages that only make a table of the store: their method of ``linkage.Run``.
TABLES = {"prepare": "sides", "union": "union", "expand": "expanded", "prune": "pruned", "judge": "judged", "stack": "scored", "refine-features": "features", "refine": "refined", "pseudo": "pseudo"}
#: Stages that fit something, and those that report.
FITS, REPORTS = ("aliases", "train-prune", "tune"), ("cross-check", "diag", "errors", "score", "validate")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    parts = [tsv.read_records(spark, f"{folder}/source{s}.tsv", s) for s in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold", description="Link source1.tsv with source2.tsv and source3.tsv of a folder.")
    p.add_argument("stage", choices=[*TABLES, *FITS, *REPORTS, "link", "splits", "mini"])
    p.add_argument("--data", required=True, help="folder of source1.tsv, source2.tsv, source3.tsv and truth.tsv")
    p.add_argument("--work", required=True, help="folder of stage tables")
    p.add_argument("--out", help="folder of results")
    p.add_argument("--force", action="store_true", help="make stages again")
    for name, value in vars(linkage.Settings()).items():
        if isinstance(value, bool):
            p.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=value)
        elif isinstance(value, int | float):
            p.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    p.add_argument("--df-cap", type=int)
    p.add_argument("--cand-from", choices=["union", "scored"], default="union")
    p.add_argument("--mini-queries", type=int, default=1000)
    p.add_argument("--mini-decoys", type=int, default=30_000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"kinfold-{a.stage}").getOrCreate()
    store = Store(spark, a.work)
    names = vars(linkage.Settings())
    settings = linkage.Settings(**{k: v for k, v in vars(a).items() if k in names and v is not None})
    records = _records(spark, a.data)
    truth = tsv.truth_pairs(tsv.read_truth(spark, f"{a.data}/truth.tsv"))
    run = linkage.Run(store, records, truth, settings, a.force)
    show = lambda df: df.show(1000, False)
    if a.stage in TABLES:
        made = getattr(run, TABLES[a.stage])()
        print(sum(x.count() for x in (made if isinstance(made, tuple) else (made,))))
    elif a.stage == "aliases":
        print(run.aliases())
    elif a.stage == "train-prune":
        print(run.pruner().importances())
    elif a.stage == "tune":
        show(run.grid().orderBy(F.desc("macro_f05")))
        print(run.decision())
    elif a.stage == "cross-check":
        show(run.cross_checked())
    elif a.stage == "diag":
        for frame in run.diagnosis().values():
            show(frame)
    elif a.stage == "errors":
        show(run.errors())
    elif a.stage == "splits":
        show(sampling.splits(records.where("src = 1").withColumnRenamed("entity_id", "s1_id"), "s1_id", settings.groups, 1).groupBy("country", "split").count())
    elif a.stage == "mini":
        s1, pool = linkage.split(records)
        few, some = sampling.mini(s1, pool, truth, a.mini_queries, a.mini_decoys)
        store.write(few, f"{a.out}/s1")
        store.write(some, f"{a.out}/pool")
    elif a.stage == "link":
        s1 = records.where("src = 1").select(F.col("entity_id").alias("s1_id"))
        tsv.write_lists(decide.match_lists(s1, run.chosen()), f"{a.out}/matching", "s1_id")
        tsv.write_lists(decide.match_lists(s1, run.candidate_pairs(), "candidate_entity_ids"), f"{a.out}/candidates", "s1_id")
    elif a.stage == "score":
        scored = evaluate.by_query(run.among(run.sides()[0], "holdout"), run.among(run.chosen(), "holdout"), run.among(truth, "holdout"))
        for frame in (evaluate.macro(scored), evaluate.macro(scored, "country"), evaluate.by_size(scored)):
            show(frame)
    else:
        s1, pool = run.sides()
        report = validate.validate(decide.match_lists(s1, run.chosen()), s1, pool, decide.match_lists(s1, run.candidate_pairs()))
        show(report)
        if a.out:
            show(validate.file_rules(spark, f"{a.out}/matching", ("s1_id", "matched_entity_ids")))
        return 0 if validate.passes(report) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
