"""python -m tabveil analyze FILE | anonymize FILE [-o OUT] [--columns 0,2] [--strategy i=NAME] [--seed HEX] [--force]"""

from __future__ import annotations

import argparse
import json
import secrets
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from tabveil.plans import service
from tabveil.sources.csvfile import output_path


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tabveil")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("file")
    b = sub.add_parser("anonymize")
    b.add_argument("file")
    b.add_argument("-o", "--out")
    b.add_argument("--columns")
    b.add_argument("--strategy", action="append", default=[])
    b.add_argument("--seed", default=None)
    b.add_argument("--force", action="store_true")
    x = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if x.command == "analyze":
        _, plans = service.analyze_csv(spark, x.file)
        print(json.dumps([asdict(c) for c in plans], indent=2))
        return 0
    controls = {int(k): {"strategy": v} for k, v in (s.split("=", 1) for s in x.strategy)}
    chosen = [int(c) for c in x.columns.split(",")] if x.columns else None
    print(json.dumps(service.anonymize_csv(spark, x.file, x.out or output_path(x.file), x.seed or secrets.token_hex(32), chosen, controls, x.force), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
