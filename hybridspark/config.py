"""Settings: validated dataclasses, filled from defaults, then the environment, then a file, then arguments."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from .operators.chunkers import ChunkConfig
from .types import ConfigError

_TRUE, _FALSE = set("1 true yes on".split()), set("0 false no off".split())


def boolean(text: str) -> bool:
    low = text.strip().lower()
    if low not in _TRUE | _FALSE:
        raise ConfigError(f"not a boolean: {text}")
    return low in _TRUE


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class EmbedderConfig:
    mode: str = "local"
    remote_url: str | None = None
    remote_timeout: float = 120.0
    model_name: str = "hashing"
    embedding_dimension: int = 2048
    batch_size: int = 8
    normalize: bool = True
    document_instruction: str | None = None
    query_instruction: str | None = None
    lru_cache_size: int = 1024

    def __post_init__(self) -> None:
        _check(self.mode in ("local", "remote"), "mode is local or remote")
        _check(self.mode == "local" or bool(self.remote_url), "remote mode needs remote_url")
        _check(self.remote_timeout > 0, "remote_timeout is positive")
        _check(1 <= self.embedding_dimension <= 2048, "embedding_dimension is 1 to 2048")
        _check(self.batch_size >= 1 and self.lru_cache_size >= 0, "batch_size is at least 1, lru_cache_size at least 0")


@dataclass(frozen=True)
class StoreConfig:
    path: str = "hybridspark-store"

    def __post_init__(self) -> None:
        _check(bool(self.path.strip()), "path is blank")


@dataclass(frozen=True)
class PipelineConfig:
    collection: str = "default"
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = tuple(".* __pycache__ node_modules .git *.pyc *.pyo".split())

    def __post_init__(self) -> None:
        _check(bool(self.collection.strip()), "collection is blank")


@dataclass(frozen=True)
class Config:
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)


def _typed(kind: Any, text: str) -> Any:
    name = str(kind)
    return boolean(text) if "bool" in name else int(text) if name.startswith("int") else float(text) if name.startswith("float") else tuple(x for x in text.split(",") if x) if name.startswith("tuple") else text


def load(path: str | None = None, env: dict[str, str] | None = None, **sections: dict[str, Any]) -> Config:
    """Defaults, then HYBRIDSPARK_<SECTION>_<FIELD> variables, then a JSON or YAML file, then ``sections``."""
    env = dict(os.environ) if env is None else env
    data: dict[str, dict[str, Any]] = {f.name: {} for f in fields(Config)}
    for section, held in data.items():
        for f in fields(type(getattr(Config(), section))):
            if (value := env.get(f"HYBRIDSPARK_{section}_{f.name}".upper())) is not None:
                held[f.name] = _typed(f.type, value)
    if path:
        for section, values in read_file(path).items():
            _check(section in data and isinstance(values, dict), f"no such section: {section}")
            data[section] |= values
    for section, values in sections.items():
        _check(section in data, f"no such section: {section}")
        data[section] |= values
    try:
        return Config(**{k: type(getattr(Config(), k))(**{n: tuple(v) if isinstance(v, list) else v for n, v in d.items()}) for k, d in data.items()})
    except TypeError as e:
        raise ConfigError(str(e)) from e


def read_file(path: str) -> dict[str, Any]:
    """A mapping from a .json, .yaml or .yml file, or another that is either."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(str(e)) from e
    made: Any = None
    try:
        made = json.loads(text)
    except ValueError:
        if path.endswith(".json"):
            raise ConfigError(f"not JSON: {path}") from None
        try:
            import yaml
        except ModuleNotFoundError:
            raise ConfigError("YAML files need the yaml module") from None
        try:
            made = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError(f"not YAML: {path}: {e}") from e
    _check(isinstance(made, dict), f"not a mapping: {path}")
    return made


def as_dict(config: Config) -> dict[str, Any]:
    return asdict(config)
