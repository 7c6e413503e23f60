"""Registries and runtime settings, read by the driver from YAML or JSON files and the environment."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import provider_error, repeated_ids, sanitize_providers, sanitize_sinks, sink_error
from ..schemas import PROVIDER, SINK


class RegistryError(ValueError):
    """A registry or a setting can't be used."""


def expand_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """``$NAME`` and ``${NAME}`` replaced by the environment's values, '' where unset."""
    env = os.environ if env is None else env
    return re.sub(r"\$(?:\{([^}]*)\}|([A-Za-z_]\w*))", lambda m: env.get(m[1] if m[1] is not None else m[2], ""), text)


def decode(text: str, suffix: str) -> object:
    """Document of a file by its suffix; without one YAML is tried, then JSON. What is wrong with it isn't told."""
    suffix = suffix.lower()
    readers = {".yaml": ["yaml"], ".yml": ["yaml"], ".json": ["json"], "": ["yaml", "json"]}.get(suffix, [])
    for kind in readers:
        try:
            if kind == "json":
                return json.loads(text)
            import yaml

            return yaml.safe_load(text)
        except Exception:  # noqa: BLE001, S112
            continue
    raise RegistryError(f"unsupported or malformed registry file ({suffix or 'no suffix'})")


def _text(path: str) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise RegistryError(f"read registry {path}: {e}") from e


def _rows(text: str, suffix: str, key: str) -> list[dict]:
    doc = decode(text, suffix)
    rows = doc.get(key) if isinstance(doc, dict) else doc
    if not isinstance(rows, list) or not rows:
        raise RegistryError(f"the registry lists no {key}")
    return [r if isinstance(r, dict) else {} for r in rows]


def _fitted(value: object, kind):
    """A decoded value as the schema's type; values of other types are left out."""
    name = kind.typeName()
    if name == "struct":
        return {f.name: _fitted(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if name == "map":
        return {str(k): v for k, v in value.items() if isinstance(v, str)} if isinstance(value, dict) else None
    if name == "string":
        return value if isinstance(value, str) else (str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None)
    if name == "boolean":
        return value if isinstance(value, bool) else None
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _checked(df: DataFrame, error) -> DataFrame:
    bad = df.select(error.alias("error")).filter("error IS NOT NULL").limit(1).collect()
    if bad:
        raise RegistryError(bad[0].error)
    twice = repeated_ids(df).orderBy("id").limit(1).collect()
    if twice:
        raise RegistryError(f"duplicate id {twice[0].id}")
    return df


def read_providers(spark: SparkSession, text: str, suffix: str = "") -> DataFrame:
    """Cleaned providers of a registry's text; one that is incomplete or repeated fails it."""
    rows = [_fitted(r, PROVIDER) for r in _rows(text, suffix, "providers")]
    return _checked(sanitize_providers(spark.createDataFrame(rows, PROVIDER)), provider_error())


def load_providers(spark: SparkSession, path: str) -> DataFrame:
    return read_providers(spark, _text(path), Path(path).suffix)


def read_sinks(spark: SparkSession, text: str, suffix: str = "", env: Mapping[str, str] | None = None) -> DataFrame:
    """Cleaned sinks of a registry's text after expansion of variables; a bad one fails it even if it is disabled."""
    rows = []
    for r in _rows(expand_env(text, env), suffix, "publishers"):
        q = r.get("queue")
        if isinstance(q, dict):
            r = r | {"queue": q | {"aws": _renamed(q.get("aws"), "uri", "queue_url")}}
        rows.append(_fitted(r, SINK))
    return _checked(sanitize_sinks(spark.createDataFrame(rows, SINK)), sink_error())


def load_sinks(spark: SparkSession, path: str, env: Mapping[str, str] | None = None) -> DataFrame:
    return read_sinks(spark, _text(path), Path(path).suffix, env)


def _renamed(value: object, old: str, new: str) -> object:
    if isinstance(value, dict) and old in value and new not in value:
        return {new if k == old else k: v for k, v in value.items()}
    return value


@dataclass(frozen=True)
class Settings:
    """Runtime settings, in seconds where they are times."""

    providers_file: str = "configs/providers.yaml"
    sinks_file: str = "configs/publishers.yaml"
    crawl_interval: int = 900
    storage_type: str = "parquet"
    storage_path: str = ""
    storage_ttl: int = 432_000
    storage_cleanup_interval: int = 43_200
    log_level: str = "info"

    def __post_init__(self) -> None:
        for name in ("crawl_interval", "storage_ttl", "storage_cleanup_interval"):
            if getattr(self, name) <= 0:
                raise RegistryError(f"{name} must be positive")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, dotenv: str = "configs/.env") -> Settings:
        """Defaults, then the optional file of NAME=value lines, then the environment."""
        found: dict[str, str] = {}
        if Path(dotenv).is_file():
            for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m:
                    found[m[1]] = m[2].strip("'\"")
        found |= dict(os.environ if env is None else env)
        values = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = found.get(name.upper())
            if raw is not None and raw != "":
                try:
                    values[name] = int(raw) if field.type == "int" else raw
                except ValueError as e:
                    raise RegistryError(f"{name} must be a number") from e
        return cls(**values)
