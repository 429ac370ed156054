"""Filters: parsing, description, and the predicate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.settings import OperationError


@dataclass(frozen=True)
class Filters:
    path_prefix: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    since: datetime | None = None

    @property
    def empty(self) -> bool:
        return not (self.path_prefix or self.extensions or self.since)

    def predicate(self, path: str = "path", extension: str = "extension", mtime: str = "source_mtime") -> Column:
        """AND of the parts given; without any, true."""
        out = F.lit(True)
        if self.path_prefix:
            any_ = F.lit(False)
            for p in self.path_prefix:
                any_ = any_ | F.startswith(F.col(path), F.lit(p))
            out = out & any_
        if self.extensions:
            out = out & F.col(extension).isin(*self.extensions)
        if self.since is not None:
            out = out & F.coalesce(F.col(mtime) >= F.lit(self.since.timestamp()), F.lit(False))
        return out

    def describe(self) -> str:
        said = []
        if self.path_prefix:
            said.append("path starts with " + " or ".join(self.path_prefix))
        if self.extensions:
            said.append("extension in " + ", ".join(self.extensions))
        if self.since is not None:
            said.append("modified since " + self.since.isoformat())
        return "; ".join(said)


def _strings(value: str | Iterable[str] | None, split: bool) -> list[str]:
    if value is None:
        return []
    items = [value] if isinstance(value, str) else list(value)
    if any(not isinstance(x, str) for x in items):
        raise ValueError("expected text or a list of texts")
    return [p for x in items for p in (x.split(",") if split else [x])]


def parse(path_prefix=None, extension=None, since=None) -> Filters:
    """Filters from request values. Extensions may be comma separated, with or without a dot; times
    without a zone are UTC."""
    prefixes = tuple(p for p in (x.strip() for x in _strings(path_prefix, False)) if p)
    extensions = []
    for e in _strings(extension, True):
        e = e.strip().lower()
        if not e.strip("."):
            raise ValueError("empty extension")
        extensions.append(e if e.startswith(".") else "." + e)
    when = None
    if isinstance(since, datetime):
        when = since
    elif since is not None and str(since).strip():
        try:
            when = datetime.fromisoformat(str(since).strip())
        except ValueError:
            raise ValueError(f"not an ISO 8601 time: {since!r}") from None
    if when is not None and when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    return Filters(prefixes, tuple(dict.fromkeys(extensions)), when)


def checked_limit(limit, most: int = 100) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise OperationError(f"limit must be a whole number from 1 to {most}")
    return limit


def clamp(top_k: int, default: int = 10, most: int = 100) -> int:
    return default if top_k < 1 else min(top_k, most)
