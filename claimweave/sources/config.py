"""Configuration: YAML with ``${NAME:-default}``, and ``.env`` files that never override."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

import yaml

_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def interpolate(value: Any, env: dict[str, str] | None = None) -> Any:
    """Values with variables put in, at any depth; one without value or default becomes empty."""
    known = os.environ if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: known.get(m[1]) or (m[2] or ""), value)
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    return [interpolate(v, env) for v in value] if isinstance(value, list) else value


def load_yaml(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    return interpolate(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, env)


def load_env(path: str, env: dict[str, str] | None = None) -> None:
    """Set the variables of an ``.env`` file that aren't set yet."""
    known = os.environ if env is None else env
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else ():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            known.setdefault(name.strip(), value.strip().strip("'\""))
