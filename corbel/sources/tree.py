"""A source tree as a table: a Python data source.

Spark's own file sources leave out names that start with `_` or `.`, and so every `__init__.py`; this one reads all.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, ord int, content binary"


class Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[int, str]]):
        self.root, self.files = root, files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.dirs = json.loads(options["dirs"])
        self.suffix = options.get("suffix", ".py")
        self.deep = options.get("deep", "true") == "true"
        self.skips = json.loads(options.get("skips", "[]"))
        self.per_task = int(options.get("filespertask", "200"))

    def partitions(self) -> list[Files]:
        """Paths are listed and filtered here; contents are read by the tasks only."""
        root, found = Path(self.root), []
        for d in self.dirs:
            top = root / d
            paths = [p for p in (top.rglob("*") if self.deep else top.glob("*")) if p.name.endswith(self.suffix) and p.is_file()]
            for p in sorted(paths):
                rel = p.relative_to(root).as_posix()
                if not any(s in "/" + rel for s in self.skips):
                    found.append((len(found), rel))
        return [Files(self.root, found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Files(self.root, [])]

    def read(self, partition: Files):
        for n, rel in partition.files:
            yield rel, n, (Path(partition.root) / rel).read_bytes()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str | Path, dirs: list[str], suffix: str = ".py", deep: bool = True, skips: tuple[str, ...] = ()) -> DataFrame:
    """(path, ord, content): files below dirs in scan order, which compares paths by components."""
    spark.dataSource.register(TreeSource)
    options = {"root": str(Path(root).resolve()), "dirs": json.dumps(dirs), "suffix": suffix, "deep": str(deep).lower(), "skips": json.dumps(list(skips))}
    return spark.read.format("source_tree").options(**options).load()
