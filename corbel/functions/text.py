"""Column functions over paths, identifiers and source text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts that the module scan skips, and length limits.
SKIPS = ("__pycache__", "/.venv/", "/venv/", "/site-packages/", "/node_modules/", "_pb2.py", "_pb2_grpc.py")
SNIPPET_LINES, CONST_CHARS, SUBJECT_CHARS, DOC_CHARS = 40, 90, 120, 200


def module_id(rel: Column, module_root: str = "") -> Column:
    root = module_root.strip("/")
    if root not in ("", "."):
        rel = F.when(rel.startswith(root + "/"), F.substring(rel, len(root) + 2, 2**31 - 1)).otherwise(rel)
    return F.replace(F.regexp_replace(rel, r"((^|/)__init__)?[.]py$", ""), F.lit("/"), F.lit("."))


def package_of(mid: Column) -> Column:
    return F.when(F.instr(mid, ".") > 0, F.regexp_replace(mid, r"[.][^.]*$", "")).otherwise(mid)


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def loc(text: Column) -> Column:
    return F.size(lines(text))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    return F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0)))


def snippet(text: Column, start: Column, end: Column, limit: int = SNIPPET_LINES) -> Column:
    """Lines start to end, limit of them at most, then how many more there are."""
    part = slice_lines(text, start, end)
    head = F.array_join(F.slice(part, 1, limit), "\n")
    return F.when(F.size(part) > limit, F.concat(head, F.lit("\n    # ... "), (F.size(part) - limit).cast("string"), F.lit(" more lines"))).otherwise(head)


def source_hash(text: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.array_join(slice_lines(text, start, end), "\n")), 1, 12)


def is_private(name: Column) -> Column:
    return name.startswith("_") & ~name.startswith("__")


def name_column(line: Column, name: Column, col: Column) -> Column:
    """0-based column of name in line from col on; col if it isn't there."""
    at = F.position(name, line, col + 1)
    return F.when(at > 0, at - 1).otherwise(col)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cut(text: Column, n: int) -> Column:
    return F.substring(strip(text), 1, n)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)[.][^.]*$", "")


def is_skipped(rel: Column, skips: Sequence[str] = SKIPS) -> Column:
    out = F.lit(False)
    for s in skips:
        out = out | F.contains(F.concat(F.lit("/"), rel), F.lit(s))
    return out


def is_test_path(rel: Column, tests: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in tests:
        t = t.rstrip("/")
        out = out | (rel == t) | rel.startswith(t + "/")
    return out


def scan_order(path: Column) -> Column:
    """Sort key of the scan: by path components, not by the path's characters."""
    return F.split(path, "/")


def doc_title(text: Column, path: Column) -> Column:
    found = F.filter(F.split(text, "\n"), lambda x: x.startswith("# "))
    return F.coalesce(F.get(F.transform(found, lambda x: strip(F.substring(x, 3, 2**31 - 1))), 0), stem(path))
