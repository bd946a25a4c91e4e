"""Settings from text with $VAR and ${VAR} filled in from the environment; unknown names stay as they are."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

VARIABLE = re.compile(r"\$(?:\{(\w+)\}|(\w+))")


def expand(text: str, environment: Mapping[str, str] | None = None) -> str:
    values = os.environ if environment is None else environment
    return VARIABLE.sub(lambda m: values.get(m.group(1) or m.group(2), m.group(0)), text)


@dataclass(frozen=True)
class Settings:
    skills_path: str = ""
    relations_path: str = ""
    courses_path: str = ""
    output_path: str = ""
    min_description: int = 10
    max_records: int = 0
    dimension: int = 1024
    top_k: int = 50
    similarity_threshold: float = 0.0


def load_settings(values: Mapping[str, object], environment: Mapping[str, str] | None = None) -> Settings:
    """Known names only; strings are expanded, then cast to the field's type."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    found = {k: kinds[k](expand(v, environment) if isinstance(v, str) else v) for k, v in values.items() if k in kinds and v is not None}
    return Settings(**found)
