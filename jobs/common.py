"""What the jobs share: config files, the command line, and folders that are read before anything was written there."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config_of(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The settings of a JSON file over ``defaults``; a name that the job doesn't know is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := given.keys() - defaults.keys():
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return {**defaults, **given}


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command(about: str, config: str, defaults: dict, job: Callable[[SparkSession, argparse.Namespace, dict], dict], *paths: str) -> None:
    """Reads the arguments and the config, makes a session, runs the job, prints its figures as JSON, and stops the session."""
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=config, help="a JSON file (%(default)s)")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(parser.prog).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(job(spark, args, config_of(spark, args.config, defaults))))
    finally:
        spark.stop()
