"""Command line: python -m onoma.plans.cli {generate,train,evaluate,report,all,ablate} [--data --model --json --markdown]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from onoma.operators.features import FEATURES
from onoma.operators.model import LogisticModel
from onoma.plans import dataset, jobs, report
from onoma.sources.pairs_csv import pairs_or_generated, read_pairs, write_pairs
from onoma.sources.strict_json import write_json

COMMANDS = ("generate", "train", "evaluate", "report", "all", "ablate")
DEFAULTS = {"data": "data/name_pairs.csv", "model": "data/model.json", "json": "", "markdown": ""}
OUTPUTS = {"report": ("reports/results.json", "reports/results.md"), "ablate": ("reports/ablation.json", "reports/ablation.md")}


def parse(args: list[str]) -> argparse.Namespace:
    """Options may stand before or after the command."""
    p = argparse.ArgumentParser(prog="onoma", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    for k, v in DEFAULTS.items():
        p.add_argument(f"--{k}", default=v)
    return p.parse_intermixed_args(args)


def session() -> SparkSession:
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    s = SparkSession.builder.appName("onoma").config("spark.executorEnv.PYTHONPATH", here).getOrCreate()
    s.sparkContext.environment["PYTHONPATH"] = here
    return s


def generate(spark: SparkSession, o: argparse.Namespace) -> int:
    path = write_pairs(dataset.labelled_pairs(spark), o.data)
    print(f"wrote {path}")
    return 0


def train(spark: SparkSession, o: argparse.Namespace) -> int:
    pairs = read_pairs(spark, o.data)
    if pairs.isEmpty():
        raise SystemExit(f"no pairs in {o.data}")
    m = jobs.train(spark, pairs, o.model)
    for name, w in m.coefficients()[:10]:
        print(f"{name:24} {w:+.4f}")
    return 0


def evaluate(spark: SparkSession, o: argparse.Namespace) -> int:
    print(report.markdown(jobs.analyse(pairs_or_generated(spark, o.data))))
    return 0


def make_report(spark: SparkSession, o: argparse.Namespace) -> int:
    a = jobs.analyse(pairs_or_generated(spark, o.data))
    to_json, to_md = OUTPUTS["report"]
    print("wrote", write_json(report.payload(a), o.json or to_json), "and", report.write_text(report.markdown(a), o.markdown or to_md))
    return 0


def ablate(spark: SparkSession, o: argparse.Namespace) -> int:
    rows = jobs.ablation(pairs_or_generated(spark, o.data))
    to_json, to_md = OUTPUTS["ablate"]
    text = report.ablation_markdown(rows)
    print(text)
    write_json(rows, o.json or to_json), report.write_text(text, o.markdown or to_md)
    return 0


def everything(spark: SparkSession, o: argparse.Namespace) -> int:
    for step in (generate, train, evaluate, make_report):
        if code := step(spark, o):
            return code
    return 0


def load_model(path: str) -> LogisticModel:
    return LogisticModel.load(path, FEATURES)


def main(args: list[str] | None = None) -> int:
    o = parse(sys.argv[1:] if args is None else args)
    steps = {"generate": generate, "train": train, "evaluate": evaluate, "report": make_report, "all": everything, "ablate": ablate}
    return steps[o.command](session(), o)


if __name__ == "__main__":
    raise SystemExit(main())
