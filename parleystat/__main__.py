"""Run a study or an export from the command line.

    python -m parleystat regression survey.csv conversation.csv results --spec 4
    python -m parleystat mediation survey.csv conversation.csv results
    python -m parleystat export turns.json turns_csv
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from parleystat.plans.studies import Study, run_mediation, run_regression
from parleystat.sources.readers import read_documents
from parleystat.sources.writers import export_csv, preview, union_of_documents


def report(study: Study) -> None:
    for fit in study.fits:
        print(f"{fit.model.name} {fit.model.published_outcome}: {fit.n} rows, R2 {fit.r_squared:.4f}")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="parleystat")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("regression", "mediation"):
        study = commands.add_parser(name)
        study.add_argument("survey")
        study.add_argument("conversation")
        study.add_argument("out")
        study.add_argument("--format", default="csv")
        if name == "regression":
            study.add_argument("--spec", type=int, default=4)
    export = commands.add_parser("export")
    export.add_argument("log")
    export.add_argument("out")
    given = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("parleystat").getOrCreate()
    if given.command == "regression":
        report(run_regression(spark, given.survey, given.conversation, given.out, given.spec, given.format))
    elif given.command == "mediation":
        report(run_mediation(spark, given.survey, given.conversation, given.out, given.format))
    else:
        log = union_of_documents([read_documents(spark, given.log)])
        export_csv(log, given.out)
        preview(log, ["_id"]).show()


if __name__ == "__main__":
    main()
