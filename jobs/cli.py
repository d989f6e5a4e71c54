"""What the jobs' command lines share: settings, a session and logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings(path: str | None, default: str) -> dict:
    """A job's settings: those of the file beside it, changed by those of ``path``; unknown names are an error."""
    known = json.loads((Path(__file__).parent / default).read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | given


def main(description: str, default: str, paths: dict[str, str], job: Callable[..., object], argv: list[str] | None = None) -> None:
    """Parse ``paths`` (name: help) and --config, then call ``job(spark, **paths, config=...)`` in a session of its own."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help=f"a JSON file of settings that differ from {default}")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(args.config, default)
    spark = SparkSession.builder.appName(description).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, **{name: getattr(args, name) for name in paths}, config=config)
    finally:
        spark.stop()
