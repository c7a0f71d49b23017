"""Configuration of a run: a flat JSON file, or YAML where a YAML reader is installed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Config:
    """What a run reads, where it keeps its store, and which hosts it takes."""

    crawler_id: str = "default"
    source: str = "parquet"
    path: str = ""
    store: str = ""
    domain_whitelist: list[str] = field(default_factory=list)
    max_depth: int = 3
    max_age_days: int = 30


def load_config(path: str) -> Config:
    """The configuration in a file. Unknown keys, and files that cannot be read, are errors."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError("this installation reads JSON configurations only") from None
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    unknown = sorted(set(values) - {f.name for f in fields(Config)})
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return Config(**values)
