"""Outputs: tables, the data document, the packed page."""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators.snapshots import write_snapshot

#: Fixed value: where a page template takes the data, gzip-packed and base64-coded.
PLACEHOLDER = "__DATA_B64__"
#: Folder of the symbols' snapshot, beside the tables; its parts and buckets: a tree's symbols are few.
SNAPSHOT, SNAPSHOT_PARTS, SNAPSHOT_BUCKETS = "symbols.snapshot", 8, 2


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    """A Parquet table each; and a snapshot of the symbols' digests, with which the next build finds what has changed."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    if "symbols" in tables:
        written = tables["symbols"].sparkSession.read.parquet(f"{out}/symbols.parquet")
        write_snapshot(written, "id", "hx", f"{out}/{SNAPSHOT}", SNAPSHOT_PARTS, SNAPSHOT_BUCKETS)


def rows_of(df: DataFrame) -> Iterable[dict]:
    """Rows as JSON values, one partition at a time on the driver."""
    for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield json.loads(r["j"])


def write_document(document: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(document, separators=(",", ":")))


def pack(data: str | Path, out: str | Path, template: str, placeholder: str = PLACEHOLDER) -> int:
    """Writes template with the data document packed in place of the placeholder; its size in bytes."""
    packed = base64.b64encode(gzip.compress(Path(data).read_bytes(), 9)).decode()
    Path(out).write_text(template.replace(placeholder, packed))
    return Path(out).stat().st_size
