"""Which files of a tree are read. Directories that are never entered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweave.functions.text import language_of

SKIPPED = frozenset(
    {
        ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".next",
        "target", ".codeweave", ".idea", ".vscode", "vendor", "coverage", "coverage-xml", "backups", ".phpunit.cache", "storage", "tmp",
        "logs", ".php-cs-fixer.cache",
    }
)


def is_source(path: Column) -> Column:
    """A relative path with a known extension and no hidden or skipped directory."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return language_of(path).isNotNull() & ~F.exists(above, lambda p: F.startswith(p, F.lit(".")) | p.isin(*sorted(SKIPPED)))
