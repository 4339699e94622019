"""Command line: run a file of requests against a configuration."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from wayfold.app import App
from wayfold.sources import config as cfg
from wayfold.sources import files
from wayfold.sources.sinks import Sink, sink_of


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wayfold", description=__doc__)
    p.add_argument("--config-file", required=True)
    p.add_argument("--query-file", required=True)
    p.add_argument("--newline-delimited", action="store_true")
    p.add_argument("--chunksize", type=int, help="requests at once; needs --newline-delimited")
    p.add_argument("--parallelism", type=int)
    p.add_argument("--output-directory")
    made = p.parse_args(argv)
    if made.chunksize is not None and not made.newline_delimited:
        p.error("--chunksize needs --newline-delimited")
    if made.chunksize is not None and made.chunksize < 1:
        p.error("--chunksize must be at least 1")
    return made


def overridden(config: dict, args: argparse.Namespace) -> dict:
    """The configuration with the command line's parallelism and output directory."""
    out = cfg.merge(config, {"parallelism": args.parallelism} if args.parallelism else {})
    policy = out.get("response_output_policy")
    if args.output_directory and isinstance(policy, dict) and policy.get("filename"):
        out["response_output_policy"] = policy | {"filename": f"{args.output_directory.rstrip('/')}/{policy['filename'].rsplit('/', 1)[-1]}"}
    return out


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("wayfold").getOrCreate()
    config = overridden(cfg.load(args.config_file), args)
    app = App.from_dict(spark, config)
    requests = files.read_request_lines(spark, args.query_file) if args.newline_delimited else files.read_requests(spark, args.query_file)
    if args.parallelism:
        requests = requests.repartition(args.parallelism)
    policy = config.get("response_output_policy")
    sink = sink_of(policy) if policy else Sink("ndjson", f"{(args.output_directory or '.').rstrip('/')}/responses")
    sink.write(app.run_frame(requests))
    return 0


if __name__ == "__main__":
    sys.exit(main())
