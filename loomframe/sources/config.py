"""Settings: a YAML-like mapping, three overrides, and paths from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass
class Settings:
    json_path: str = ""
    output_dir: str = ""
    loss_log: str = ""
    max_length: int = 2048
    batch_size: int = 8
    extra: dict = field(default_factory=dict)


def settings(values: dict, overrides: dict | None = None) -> Settings:
    """Known keys to fields, the rest to extra; overrides that are not None win."""
    values = dict(values) | {k: v for k, v in (overrides or {}).items() if v is not None}
    names = {f.name for f in fields(Settings)} - {"extra"}
    return Settings(**{k: v for k, v in values.items() if k in names}, extra={k: v for k, v in values.items() if k not in names})


def read_settings(path: str, overrides: dict | None = None) -> Settings:
    try:
        import yaml
    except ImportError:  # flat `key: value` files do without
        with open(path) as f:
            pairs = (line.split("#")[0].partition(":") for line in f if ":" in line.split("#")[0])
            return settings({k.strip(): int(v) if v.strip().isdigit() else v.strip() for k, _, v in pairs}, overrides)
    with open(path) as f:
        return settings(yaml.safe_load(f) or {}, overrides)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
