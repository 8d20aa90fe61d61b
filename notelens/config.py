"""Settings from the environment and a ``.env`` file; the environment wins."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "NOTELENS_"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    roots: tuple[str, ...]
    index_dir: str
    excludes: tuple[str, ...] = field(default=())
    reindex_minutes: float = 10.0
    parent_chars: int = 3000

    def note_key(self, file: str) -> str:
        for root in self.roots:
            rel = os.path.relpath(file, root).replace(os.sep, "/")
            if not rel.startswith("../"):
                return rel if len(self.roots) == 1 else f"{os.path.basename(root)}/{rel}"
        raise ConfigError(f"{file} is under no root")

    def resolve_key(self, key: str) -> str:
        if len(self.roots) == 1:
            return os.path.join(self.roots[0], *key.split("/"))
        name, _, rel = key.partition("/")
        for root in self.roots:
            if os.path.basename(root) == name:
                return os.path.join(root, *rel.split("/"))
        raise ConfigError(f"no root is named {name}")


def read_dotenv(path: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8-sig") as f:
            for line in f:
                key, sign, value = line.strip().partition("=")
                if sign and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
    return out


def _number(values: Mapping[str, str], name: str, default: float, least: float) -> float:
    try:
        out = float(values.get(PREFIX + name, default))
    except ValueError as e:
        raise ConfigError(f"{PREFIX}{name} is no number") from e
    if out < least:
        raise ConfigError(f"{PREFIX}{name} is below {least:g}")
    return out


def load_config(env: Mapping[str, str] | None = None, dotenv: str = ".env") -> Config:
    values = read_dotenv(dotenv) | dict(os.environ if env is None else env)
    roots = tuple(os.path.normpath(r.strip()) for r in values.get(PREFIX + "ROOTS", "").split(os.pathsep) if r.strip())
    if not roots:
        raise ConfigError(f"{PREFIX}ROOTS names no folder")
    for root in roots:
        if not os.path.isdir(root):
            raise ConfigError(f"{root} is no folder")
    if len({os.path.basename(r) for r in roots}) < len(roots):
        raise ConfigError("two roots have one name")
    if any(a != b and os.path.commonpath([a, b]) == a for a in roots for b in roots):
        raise ConfigError("one root lies in another")
    index = os.path.normpath(values.get(PREFIX + "INDEX", os.path.join(os.path.expanduser("~"), ".notelens")))
    if any(os.path.commonpath([os.path.abspath(index), os.path.abspath(r)]) == os.path.abspath(r) for r in roots):
        raise ConfigError("the index lies in a root")
    excludes = tuple(x.strip() for x in values.get(PREFIX + "EXCLUDES", "").split(",") if x.strip())
    return Config(roots, index, excludes, _number(values, "REINDEX_MINUTES", 10, 0), int(_number(values, "PARENT_CHARS", 3000, 0)))
