"""Configuration files: found upward from the project, read from YAML, and made from the rules' options."""

from __future__ import annotations

import warnings
from pathlib import Path

import yaml

from lispmill.operators.registry import CLOJURE, RULES
from lispmill.plans.analyze import Config

NAMES = (".lispmill.yaml", ".lispmill.yml")
MARKS = (".git", "project.clj", "deps.edn")


def project_root(start: str) -> Path:
    """The nearest folder above that looks like a project's, else the start's own."""
    at = Path(start).resolve()
    at = at if at.is_dir() else at.parent
    return next((p for p in (at, *at.parents) if any((p / m).exists() for m in MARKS)), at)


def find(start: str) -> Path | None:
    root = project_root(start)
    for place in (root, *root.parents, Path.cwd(), Path.home()):
        for name in NAMES:
            if (place / name).is_file():
                return place / name
    return None


def load(path: str | Path | None) -> Config:
    if path is None:
        return Config()
    data = yaml.safe_load(Path(path).read_text()) or {}
    config = Config(data.get("enabled-groups") or {}, data.get("enabled-rules") or {}, data.get("rule-config") or {}, bool(data.get("analyze-tests", False)))
    for name in config.unknown():
        warnings.warn(f"{path}: unknown {name}", stacklevel=2)
    return config


def generate() -> str:
    """A configuration with every group and every rule option at its default."""
    groups = {g: g == CLOJURE for g in sorted({r.group for r in RULES.values()})}
    options = {r.id: {k.replace("_", "-"): list(v) if isinstance(v, tuple) else v for k, v in r.options.items()} for _, r in sorted(RULES.items()) if r.options}
    return yaml.safe_dump({"analyze-tests": False, "enabled-groups": groups, "enabled-rules": {}, "rule-config": options}, sort_keys=False)
