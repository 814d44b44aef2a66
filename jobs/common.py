"""What the jobs share: settings, logs, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

T = TypeVar("T")


def load_config(kind: type[T], path: str | Path) -> T:
    """A JSON object as kind; names that kind doesn't have are an error."""
    given: dict[str, Any] = json.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**given)


class Counted:
    """Counts of a table's rows, taken while something else reads it. Where nothing had to read it (another input of a join was
    empty, say) they are counted then."""

    def __init__(self, df: DataFrame, **counts: Column) -> None:
        self._counts, self._plain, self._seen = counts, df, Observation()
        self.df = df.observe(self._seen, *[c.alias(name) for name, c in counts.items()])

    def get(self) -> dict[str, int]:
        try:
            return self._seen.get
        except Py4JJavaError:  # no figures came back
            return self._plain.agg(*[c.alias(name) for name, c in self._counts.items()]).first().asDict()


def command_line(about: str | None, name: str, paths: dict[str, str]) -> argparse.Namespace:
    """--config, and a required option for each of paths (name: help)."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--config", default=str(Path(__file__).parent / f"{name}.json"))
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return parser.parse_args()


def own_session(name: str) -> SparkSession:
    """For command lines only: master and resources come from spark-submit or the environment."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
