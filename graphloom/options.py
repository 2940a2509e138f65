"""Options of an analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

#: Interface and command-line defaults, and the limits of a source scan.
UI_LIMITS = (60, 200)
CLI_LIMITS = (40, 80)
HUBS = 6
SOURCE_FILE_BYTES = 2 * 1024 * 1024
SOURCE_FILES = 8000


def positive_int(value: object, fallback: int) -> int:
    """The value as a positive whole number, else ``fallback``."""
    try:
        found = int(str(value).strip())
    except ValueError:
        return fallback
    return found if found > 0 else fallback


@dataclass(frozen=True)
class AnalyzeOptions:
    """``path_mode`` is ``portable`` (keys keep their case) or ``windows`` (keys are lower-cased)."""

    max_nodes: int = UI_LIMITS[0]
    max_edges: int = UI_LIMITS[1]
    path_mode: str = "portable"
    max_source_files: int = SOURCE_FILES
    max_source_bytes: int = SOURCE_FILE_BYTES

    def __post_init__(self) -> None:
        if self.path_mode not in ("portable", "windows"):
            raise ValueError("path_mode is 'portable' or 'windows'")

    @property
    def nodes(self) -> int:
        return max(1, self.max_nodes)

    @property
    def edges(self) -> int:
        return max(1, self.max_edges)


def parse_arguments(args: Sequence[str]) -> dict[str, str]:
    """``--key value`` pairs by lower-cased key; a bare flag is ``true``, the last one wins, other words are ignored."""
    found: dict[str, str] = {}
    for i, arg in enumerate(args):
        if arg.startswith("--"):
            after = args[i + 1] if i + 1 < len(args) else "--"
            found[arg[2:].lower()] = "true" if after.startswith("--") else after
    return found
