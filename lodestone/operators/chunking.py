"""Chunking: one document to its pieces.

Windows are plain Columns. Headings, paragraphs, overlap and merging depend on what stands before, so
they run over a document's sections inside a Pandas UDF.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import chain, groupby, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import documents as D

_SECTION = re.compile(r"(?=^#{1,3}\s)", re.MULTILINE)
_LEVEL = re.compile(r"\s*(#{1,6})\s")


def windows(content: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters; the step is shorter by the overlap, where that leaves a step."""
    step = size - overlap if 0 < overlap < size else size
    cut = F.transform(F.sequence(F.lit(0), F.length(content) - 1, F.lit(step)), lambda at: F.substring(content, at + 1, F.lit(size)))
    return F.when(F.length(content) <= size, F.array(content)).otherwise(cut)


@dataclass
class Chunker:
    """Pieces of one document, in separate passes: cut into sections, group, fill pieces, repeat headings, merge."""

    size: int = 1500
    overlap: int = 100

    def _joined(self, before: str, piece: str) -> str:
        """piece with text before it, if that fits."""
        return both if before and len(both := f"{before}\n\n{piece}") <= self.size else piece

    def _after(self, before: str, piece: str) -> str:
        """piece, opened with the end of the one before it."""
        return self._joined(before[-self.overlap :] if self.overlap > 0 else "", piece)

    def _filled(self, texts: Iterable[str], glue: int, before: str = "") -> list[str]:
        """Texts joined into pieces for as long as both, and glue characters, fit."""
        out: list[str] = []
        for text in texts:
            if out and len(out[-1]) + glue + len(text) <= self.size:
                out[-1] = f"{out[-1]}\n\n{text}"
            else:
                out.append(self._after(out[-1] if out else before, text))
        return out

    def _windows(self, text: str) -> list[str]:
        step = self.size - self.overlap if 0 < self.overlap < self.size else self.size
        return [text[at : at + self.size] for at in range(0, len(text), step)]

    def paragraphs(self, text: str) -> list[str]:
        """Paragraphs filled into pieces; those too large come as windows, which take no part in filling."""
        out: list[str] = []
        for large, run in groupby(filter(None, text.split("\n\n")), key=lambda p: len(p) > self.size):
            out += chain.from_iterable(map(self._windows, run)) if large else self._filled(run, 2, out[-1] if out else "")
        return out

    @staticmethod
    def level(section: str) -> int | None:
        """Heading level of the first line that is not blank."""
        found = _LEVEL.match(section)
        return len(found[1]) if found else None

    @staticmethod
    def _headings(section: str) -> str:
        """Heading lines a section starts with, blank lines between them left out."""
        lines = filter(None, map(str.strip, section.splitlines()))
        return "\n".join(takewhile(lambda x: x.startswith("#"), lines))

    def _large(self, section: str) -> list[str]:
        """Pieces of a section that fits into none; each opens with its headings, where those fit."""
        heads = self._headings(section)
        first, *rest = self.paragraphs(section)
        return [first, *(p if p.lstrip().startswith(heads) else self._joined(heads, p) for p in rest)]

    def headings(self, content: str) -> list[str]:
        sections = [(s, self.level(s), len(s) > self.size) for s in map(str.strip, _SECTION.split(content)) if s]
        out: list[str] = []
        last: tuple[int | None, bool] | None = None
        # neighbours of one level share pieces; a large section has its own
        for (level, large), run in groupby(sections, key=lambda s: s[1:]):
            if not large:
                out += self._filled((s for s, *_ in run), 0)
                last = level, large
                continue
            for section, *_ in run:
                pieces = self._large(section)
                # its overlap stops at a change of level, but not between two large ones
                if last is not None and (last[1] or last[0] == level):
                    pieces[0] = self._after(out[-1], pieces[0])
                out += pieces
                last = level, large
        return self._merge(out) or [content]

    def _merge(self, pieces: list[str]) -> list[str]:
        """Tiny pieces join the next one, else the one before, if the two fit."""
        tiny = 200 if self.size >= 200 else max(10, self.size // 2)
        fit = lambda a, b: len(a) + 2 + len(b) <= self.size
        out: list[str] = []
        rest = deque(pieces)
        while rest:
            group = [rest.popleft()]
            if len(group[0]) < tiny and rest and fit(group[0], rest[0]):
                group.append(rest.popleft())
            elif len(group[0]) < tiny and out and fit(out[-1], group[0]):
                group.insert(0, out.pop())
            out.append("\n\n".join(group))
        return out

    def pieces(self, content: str) -> list[str]:
        """At least one piece: a document without a body keeps its card in an empty one."""
        return self.headings(content) if content.strip() else [""]


def heading_pieces(size: int, overlap: int) -> Callable[[Column], Column]:
    chunker = Chunker(size, overlap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(content: pd.Series) -> pd.Series:
        return content.map(lambda c: chunker.pieces(c or ""))

    return split


def build_chunks(docs: DataFrame, size: int = 1500, overlap: int = 100, by: str = "headings") -> DataFrame:
    """Documents (types.DOCS) to chunks (types.CHUNKS); by "headings" or plain "windows"."""
    content = F.coalesce(F.col("content"), F.lit(""))
    pieces = heading_pieces(size, overlap)(content) if by == "headings" else windows(content, size, overlap)
    cut = docs.withColumn("_pieces", pieces).withColumn("chunk_count", F.size("_pieces"))
    # outer, though no list is empty: an inner one would be filtered by its size first, and made twice for that
    rows = cut.select("*", F.posexplode_outer("_pieces").alias("chunk_index", "piece")).drop("_pieces")
    lead = F.when(F.col("chunk_index") == 0, D.card(F.col("aliases"), F.col("summary"))).otherwise(F.lit(""))
    return rows.select(
        "collection", "path", "chunk_index", "chunk_count", F.concat_ws("::", "path", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "title", "folder", D.breadcrumb(F.col("piece"), F.col("title")).alias("breadcrumb"), "extension", F.col("mtime").alias("source_mtime"),
        "aliases", "status", "as_of", "piece", D.contextual(F.col("title"), F.col("folder"), F.col("piece"), lead).alias("text"),
    )
