"""Where a repository keeps code, tests and docs. Driver-side configuration, not data."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from corbel.functions.text import SKIPS

#: Directories that hold tests.
TEST_DIRS = ("tests", "test")


class LayoutError(ValueError):
    """The directory alone doesn't tell the layout."""


@dataclass(frozen=True)
class Layout:
    """Paths are relative to the repository's root."""

    pkg_dir: str
    module_root: str
    import_prefix: str
    tests: tuple[str, ...] = ()
    skip: tuple[str, ...] = SKIPS
    docs_dir: str = "docs"

    def skips(self, rel: str) -> bool:
        path = "/" + rel
        return any(part in path for part in self.skip)

    def is_test(self, rel: str) -> bool:
        roots = [t.rstrip("/") for t in self.tests]
        return rel in roots or rel.startswith(tuple(r + "/" for r in roots))

    @classmethod
    def detect(cls, root: str | Path) -> Layout:
        """The one package in src/, or else in the root itself."""
        root = Path(root)
        tests = tuple(t for t in TEST_DIRS if (root / t).is_dir())

        def packages(where: Path, own: bool) -> list[str]:
            if not where.is_dir():
                return []
            names = sorted(p.name for p in where.iterdir() if (p / "__init__.py").exists())
            return [n for n in names if not own or n not in TEST_DIRS and n[0] not in "._"]

        for base, module_root, own in ((root / "src", "src", False), (root, ".", True)):
            names = packages(base, own)
            if len(names) > 1:
                raise LayoutError(f"more than one package: {', '.join(names)}; choose one with --pkg-dir")
            if names:
                pkg = names[0] if own else f"src/{names[0]}"
                return cls(pkg, module_root, names[0], tests)
        raise LayoutError(f"no package below {root}; give --pkg-dir, --module-root and --import-prefix")
