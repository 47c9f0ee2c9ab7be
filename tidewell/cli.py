"""``python -m tidewell.cli``: write a configuration, run one, or generate synthetic patients."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import config, scm
from .plans.runner import ExperimentRunner
from .sources import datasets as S
from .sources.segments import in_batches


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewell")
    commands = top.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a configuration to start from")
    init.add_argument("--output", default="config.json")
    run = commands.add_parser("run", help="run a configuration")
    run.add_argument("--config", required=True)
    run.add_argument("--output-dir")
    run.add_argument("--skip-pretraining", action="store_true")
    run.add_argument("--skip-plasmode", action="store_true")
    make = commands.add_parser("generate", help="synthetic patients of a structural model")
    make.add_argument("--config", help="a JSON file of all settings; those below go before it")
    make.add_argument("--question")
    make.add_argument("--spec", help="a JSON file of confounders, equations and statistics")
    make.add_argument("--num-confounders", type=int)
    make.add_argument("--dataset-size", type=int)
    make.add_argument("--treatment-coefficient", type=float)
    make.add_argument("--target-treatment-rate", type=float)
    make.add_argument("--target-control-outcome-rate", type=float)
    make.add_argument("--seed", type=int)
    make.add_argument("--output-dir")
    for command in (run, make):
        command.add_argument("--verbose", action="store_true")
    return top


def generator_config(args: argparse.Namespace) -> scm.GeneratorConfig:
    made = scm.GeneratorConfig.from_json(args.config) if args.config else scm.GeneratorConfig()
    known = {f.name for f in dataclasses.fields(made)}
    return dataclasses.replace(made, **{k: v for k, v in vars(args).items() if k in known and v is not None})


#: Patients of a batch that is made and logged at once.
BATCH = 1_000_000


def generate(spark: SparkSession, settings: scm.GeneratorConfig) -> dict:
    """Rescale, then calibrate, then write ``dataset`` in batches, going on where an interrupted run stopped, and ``metadata``."""
    std = settings.target_logit_std
    model = scm.calibrated(scm.rescaled(settings.model(), spark, std, std), spark, settings.target_treatment_rate, settings.target_control_outcome_rate)
    ids = spark.range(settings.dataset_size).select(F.col("id").alias("patient_id"))
    rows = in_batches(ids, f"{settings.output_dir}/dataset", lambda new: scm.patients(new, model), "patient_id", max(1, settings.dataset_size // BATCH))
    meta = {"statistics": scm.dataset_statistics(rows).first().asDict(), "model": dataclasses.asdict(model), "settings": settings.to_dict()}
    S.write_json(meta, f"{settings.output_dir}/metadata", spark)
    return meta["statistics"]


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    if args.command == "init":
        return config.create_default_config(args.output).to_dict()
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    if args.command == "generate":
        out = generate(spark, generator_config(args))
    else:
        c = config.Experiment.from_json(args.config)
        if args.output_dir is not None:
            c.output_dir = args.output_dir
        c.pretraining.enabled &= not args.skip_pretraining
        c.plasmode_experiments.enabled &= not args.skip_plasmode
        out = ExperimentRunner(spark, c).run()
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
