"""Command line: `python -m corbel.cli build ROOT --out DIR`."""

from __future__ import annotations

import argparse
import dataclasses
import re
import shlex
import sys
from collections.abc import Iterator
from pathlib import Path

from corbel.build import BuildOptions, build, build_shard, document
from corbel.layout import Layout, LayoutError
from corbel.session import session
from corbel.sinks import pack, write_document, write_tables

PLAIN_PAGE = '<!DOCTYPE html><meta charset="utf-8"><title>corbel</title><script id="data" type="text/plain">__DATA_B64__</script>'

#: The options of `build`, by what they are about; the layout's are named as its fields.
OPTIONS = {
    "project": {
        "--out": {"type": Path, "default": Path("corbel-out"), "help": "output directory"},
        "--name": {"help": "project name (default: the directory's)"},
        "--git-dir": {"type": Path, "help": "repository of the history (default: root)"},
        "--template": {"type": Path, "help": "page template with the placeholder"},
    },
    "layout": {
        "--pkg-dir": {"help": "package directory"},
        "--module-root": {"help": "directory that module names start from"},
        "--import-prefix": {"help": "imports that count start with this"},
        "--tests": {"action": "append", "help": "test directory; may be repeated"},
        "--skip": {"action": "append", "help": "part of paths to leave out; may be repeated"},
        "--docs-dir": {"help": "directory of markdown docs"},
    },
    "call graph": {
        "--no-lsp": {"action": "store_true", "help": "no call graph"},
        "--server": {"help": "command of a call-hierarchy server (default: links by name, without a server)"},
        "--workers": {"type": int, "default": 8, "help": "sessions of the server, or threads"},
        "--tests-by-name": {"type": Path, "help": "tree whose tests are linked by name"},
    },
    "parts and updates": {
        "--shard": {"help": "i/N: resolve one shard into --facts-dir"},
        "--facts-dir": {"type": Path, "help": "fact files: written with --shard, merged otherwise"},
        "--prev-data": {"type": Path, "help": "tables or data.json of the previous build"},
        "--prev-root": {"type": Path, "help": "checkout of the previous build"},
    },
}
SHARD = re.compile(r"(\d+)/(\d+)")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corbel", description="Code, tests, docs and history of a Python repository as tables.")
    command = top.add_subparsers(dest="cmd", required=True).add_parser("build", help="build the tables, data.json and index.html")
    command.add_argument("root", type=Path, help="checkout")
    for title, options in OPTIONS.items():
        group = command.add_argument_group(title)
        for flag, how in options.items():
            group.add_argument(flag, **how)
    return top


def layout_of(a: argparse.Namespace) -> Layout:
    """The detected layout, overridden by whatever is given; what must be detected is detected only then."""
    given = {f.name: getattr(a, f.name) for f in dataclasses.fields(Layout) if getattr(a, f.name, None) is not None}
    given |= {k: tuple(v) for k, v in given.items() if isinstance(v, list)}
    needed = [f.name for f in dataclasses.fields(Layout) if f.default is dataclasses.MISSING]
    if all(n in given for n in needed):
        return Layout(**given)
    return dataclasses.replace(Layout.detect(a.root), **given)


def complaints(a: argparse.Namespace) -> Iterator[str]:
    """What is wrong with the options taken together."""
    if a.shard is not None:
        m = SHARD.fullmatch(a.shard)
        if not m or int(m[1]) >= int(m[2]):
            yield f"'{a.shard}' names no shard; 0/4 is the first of four"
        if a.facts_dir is None:
            yield "a shard writes fact files: say where with --facts-dir"
    elif (a.prev_data is None) != (a.prev_root is None):
        yield "an update needs both the previous build (--prev-data) and its checkout (--prev-root)"


def say(text: str) -> None:
    print(f"corbel: {text}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    wrong = list(complaints(a))
    try:
        layout = layout_of(a)
    except LayoutError as e:
        wrong.append(str(e))
    for text in wrong:
        say(text)
    if wrong:
        return 2
    if not layout.tests:
        say("no test directories; --tests names them")
    opts = BuildOptions(a.root, layout, a.git_dir, a.name, not a.no_lsp, a.tests_by_name, a.facts_dir, a.prev_data, a.prev_root)
    if a.server:
        from corbel.sources.lsp import ServerResolver

        opts.resolver = ServerResolver(a.root, layout, tuple(shlex.split(a.server)), a.workers)
    spark = session(a.workers)
    if a.shard:
        i, n = SHARD.fullmatch(a.shard).groups()
        counts = build_shard(spark, opts, int(i), int(n), say)
        say(", ".join(f"{k}={v}" for k, v in counts.items()))
        return 0
    built = build(spark, opts)
    a.out.mkdir(parents=True, exist_ok=True)
    write_tables(built.tables(), str(a.out))
    write_document(document(built, opts), a.out / "data.json")
    page = a.out / "index.html"
    size = pack(a.out / "data.json", page, a.template.read_text() if a.template else PLAIN_PAGE)
    for table in built.tables():
        say(f"{table}: {built.info[table]} rows")
    say(f"{page}: {size:,} bytes, after {built.info['build_seconds']} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
