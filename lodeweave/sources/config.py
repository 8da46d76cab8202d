"""Rule files (S5): YAML text or a path, parsed and validated."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from lodeweave.operators.rules import checked_config


def rules_from_yaml(text: str) -> dict:
    """The checked configuration of a YAML text; defaults where it cannot be parsed or no YAML library is installed."""
    try:
        import yaml

        return checked_config(yaml.safe_load(text))
    except Exception:
        return checked_config(None)


@lru_cache(32)
def _read(path: str, changed: float) -> dict:
    return rules_from_yaml(Path(path).read_text(encoding="utf-8", errors="replace"))


def rules_from_file(path: str) -> dict:
    """As ``rules_from_yaml``; a file is read again when it has changed, a missing one gives the defaults."""
    p = Path(path)
    return _read(path, p.stat().st_mtime) if p.is_file() else checked_config(None)
