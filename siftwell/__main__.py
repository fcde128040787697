"""python -m siftwell evaluate | export-spam-features"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from siftwell.plans import api


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siftwell")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate", help="metrics of a labelled JSON-lines corpus")
    one.add_argument("--input", required=True)
    one.add_argument("--threshold", type=float, default=0.5)
    one.add_argument("--params", help="JSON file of a trained model; the baseline classifier without it")
    two = commands.add_parser("export-spam-features", help="training rows of the spam-labelled records")
    two.add_argument("--input", required=True)
    two.add_argument("--source", required=True)
    two.add_argument("--output", required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "evaluate":
        params = json.load(open(a.params)) if a.params else None
        print(json.dumps({r.signal: r.asDict() for r in api.evaluate(spark, a.input, a.threshold, params).collect()}, indent=2))
    else:
        print(json.dumps({"records": api.export_spam_features(spark, a.input, a.source, a.output)}))


if __name__ == "__main__":
    main()
