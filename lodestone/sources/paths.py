"""Path rules: what is hidden, what an ignore file leaves out, and how a path is really spelled."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_FILE = ".lodestoneignore"


def visible(path: Column, exclude: Sequence[str] = ()) -> Column:
    """No part starts with a dot or is, as a whole, an excluded name."""
    hidden = lambda p: F.startswith(p, F.lit(".")) | (p.isin(*exclude) if exclude else F.lit(False))
    return ~F.exists(F.split(path, "/"), hidden)


def is_hidden(relative: str, exclude: Sequence[str] = ()) -> bool:
    return any(p.startswith(".") or p in exclude for p in relative.split("/"))


def excluded(path: Path, root: Path, exclude: Sequence[str] = ()) -> bool:
    """Whether a file is outside the root or hidden, as asked for and as resolved."""
    real_root = Path(os.path.realpath(root))
    for p, base in ((Path(os.path.abspath(path)), Path(os.path.abspath(root))), (Path(os.path.realpath(path)), real_root)):
        try:
            relative = p.relative_to(base).as_posix()
        except ValueError:
            return True
        if relative != "." and is_hidden(relative, exclude):
            return True
    return False


class IgnoreRules:
    """gitignore patterns: the last that matches decides, `!` takes back, a final / means folders only."""

    def __init__(self, text: str = ""):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            line = line[1:] if line.startswith(("\\#", "\\!")) else line
            folder = line.endswith("/")
            body = line.rstrip("/")
            if body:
                anchored = "/" in body
                self.rules.append((re.compile(self._regex(body.lstrip("/"), anchored) + r"\Z"), negated, folder))
        self.negations = any(n for _, n, _ in self.rules)

    @staticmethod
    def _regex(pattern: str, anchored: bool) -> str:
        out, i = "" if anchored else "(?:.*/)?", 0
        while i < len(pattern):
            c = pattern[i]
            if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
                out, i = out + ".+", i + 2
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
                inside = pattern[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            elif c == "\\" and i + 1 < len(pattern):
                out, i = out + re.escape(pattern[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        return out

    def _says(self, path: str, folder: bool) -> bool | None:
        said = None
        for rule, negated, only_folders in self.rules:
            if (folder or not only_folders) and rule.match(path):
                said = not negated
        return said

    def ignored(self, path: str, folder: bool = False) -> bool:
        """A file in an ignored folder is ignored, whatever later rules say of the file itself."""
        parts = path.split("/")
        for i in range(1, len(parts)):
            if self._says("/".join(parts[:i]), True):
                return True
        return bool(self._says(path, folder))

    def prunable(self, folder: str) -> bool:
        """Whether nothing under this folder can be visible, so that it need not be listed."""
        return self.ignored(folder, True)

    @classmethod
    def load(cls, root: Path) -> "IgnoreRules":
        file = root / IGNORE_FILE
        try:
            stat = file.stat()
        except FileNotFoundError:
            return cls()
        return _loaded(str(file), stat.st_mtime_ns, stat.st_size)


@lru_cache(maxsize=64)
def _loaded(file: str, mtime: int, size: int) -> IgnoreRules:
    return IgnoreRules(Path(file).read_text(encoding="utf-8"))


def spelled(root: Path, relative: str) -> str:
    """The path as it is on disk, found by exact name, else by the one that differs in case or form only."""
    here, out = root, []
    for part in relative.split("/"):
        names = os.listdir(here)
        if part not in names:
            key = unicodedata.normalize("NFC", part).casefold()
            alike = [n for n in names if unicodedata.normalize("NFC", n).casefold() == key]
            if len(alike) != 1:
                raise FileNotFoundError(relative) if not alike else ValueError(f"ambiguous path: {relative}")
            part = alike[0]
        out.append(part)
        here = here / part
    return "/".join(out)
