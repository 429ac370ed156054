"""Settings, collections and the error classes of the retrieval engine."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path


class LodestoneError(Exception):
    """Base of all errors raised on purpose."""


class BusyError(LodestoneError):
    """Another writer holds the index."""


class CorruptIndexError(LodestoneError):
    """What is stored is not a readable index."""


class OperationError(LodestoneError):
    """A request that cannot be served."""


class NotFoundError(OperationError):
    """The document is not there or not visible."""


class ReadError(OperationError):
    """A visible document that cannot be read."""


class ReindexError(OperationError):
    """Some collections could not be rebuilt; says which were and which were not."""

    def __init__(self, completed: list[str], failed: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))
        self.completed, self.failed = completed, failed


@dataclass(frozen=True)
class ModelSpec:
    name: str
    dims: int
    runtime: str


# Models that an index can name, with their dimensions.
MODELS = {
    "hashed-64": ModelSpec("hashed-64", 64, "builtin"),
    "all-MiniLM-L6-v2": ModelSpec("all-MiniLM-L6-v2", 384, "onnx"),
    "bge-base-en-v1.5": ModelSpec("bge-base-en-v1.5", 768, "onnx"),
}
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    """One value object for every builder; nothing is read from the Spark configuration."""

    kb_path: str | None = None
    collections: str = ""
    index_root: str | None = None
    exclude: tuple[str, ...] = ()
    model: str = "hashed-64"
    chunk_size: int = 1500
    overlap: int = 100
    k1: float = 1.2
    b: float = 0.5
    stem: bool = True
    log_level: str = "INFO"
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if not 0 < self.chunk_size <= 10_000:
            raise ValueError("chunk_size must be in 1..10000")
        if self.overlap < 0:
            raise ValueError("overlap must not be negative")
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model!r}")
        if self.log_level.upper() not in LOG_LEVELS:
            raise ValueError(f"unknown log level {self.log_level!r}")
        if self.chunk_size > 5000:
            object.__setattr__(self, "warnings", ("chunks above 5000 characters dilute ranking",))

    @property
    def spec(self) -> ModelSpec:
        return MODELS[self.model]

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "LODESTONE_") -> "Settings":
        env = dict(os.environ if env is None else env)
        made: dict = {}
        kinds = {"chunk_size": int, "overlap": int, "k1": float, "b": float, "stem": lambda v: v.lower() in ("1", "true", "yes")}
        for name in cls.__dataclass_fields__:
            if (raw := env.get(prefix + name.upper())) is not None and name != "warnings":
                made[name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if name == "exclude" else kinds.get(name, str)(raw)
        return cls(**made)

    def resolved_collections(self) -> dict[str, Path]:
        """Name to root; either one root or a list `name:path,...`, not both and not neither."""
        if bool(self.kb_path) == bool(self.collections.strip()):
            raise ValueError("set exactly one of kb_path and collections")
        if self.kb_path:
            root = Path(self.kb_path).expanduser()
            if not root.is_dir():
                raise ValueError(f"not a folder: {root}")
            return {re.sub(r"[^A-Za-z0-9_-]+", "-", root.resolve().name).strip("-") or "default": root}
        found: dict[str, Path] = {}
        for item in filter(None, (x.strip() for x in self.collections.split(","))):
            name, colon, path = item.partition(":")
            name, root = name.strip(), Path(path.strip()).expanduser()
            if not colon or not path.strip():
                raise ValueError(f"expected name:path, got {item!r}")
            if not re.fullmatch(r"[A-Za-z0-9_-]+", name) or name.lower() == "all":
                raise ValueError(f"not a collection name: {name!r}")
            if name in found:
                raise ValueError(f"collection {name!r} stands twice")
            if not root.is_dir():
                raise ValueError(f"not a folder: {root}")
            found[name] = root
        if not found:
            raise ValueError("no collections")
        return found

    def index_location(self, root: Path, collection: str | None = None) -> Path:
        if not self.index_root:
            return root / ".lodestone" / "index"
        base = Path(self.index_root).expanduser()
        return base / collection if collection else base

    def recipe(self) -> dict[str, str | int | float]:
        """What decides the contents of an index; equal recipes can reuse chunks."""
        return {
            "model": self.model, "dims": self.spec.dims, "runtime": self.spec.runtime, "chunk_size": self.chunk_size,
            "overlap": self.overlap, "k1": self.k1, "b": self.b, "stem": int(self.stem), "analyzer": 1, "transform": 1,
        }

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)


def distinct_targets(targets: dict[str, Path]) -> None:
    """Refuse collections whose index folders are one place on disk."""
    seen: dict[str, str] = {}
    for name, path in targets.items():
        real = os.path.realpath(path)
        key = real.casefold() if os.path.exists(real.swapcase()) and os.path.samefile(real, real.swapcase()) else real
        if key in seen:
            raise ValueError(f"collections {seen[key]!r} and {name!r} share the index folder {real}")
        seen[key] = name
