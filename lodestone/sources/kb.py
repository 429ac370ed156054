"""The live files of a knowledge base as a Spark data source.

Spark's own file sources skip names that start with an underscore; here only dot names, excluded names
and ignored paths are left out. The driver lists names, as it does for Spark's own sources, and tasks read
FILES of them each, however they lie in folders; folders that nothing can bring back are never listed. register() once a session, then spark.read.format("lodestone_kb").option(...).
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone import types
from lodestone.functions import documents as D
from lodestone.settings import ReadError
from lodestone.sources.paths import IgnoreRules, excluded

BLOCK, FILES = 1 << 16, 500


def hash_file(path: Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def walk(root: Path, start: str = "", exclude: tuple[str, ...] = ()) -> Iterator[str]:
    """Relative paths of visible, supported files in order; start is a folder or file within the root."""
    rules = IgnoreRules.load(root)
    base = root / start if start else root
    if not base.exists() or (start and excluded(base, root, exclude)):
        return
    if base.is_file():
        if _wanted(root, base, rules, exclude):
            yield base.relative_to(root).as_posix()
        return
    for here, folders, names in os.walk(base):
        relative = Path(here).relative_to(root)
        folders[:] = sorted(
            f for f in folders if not f.startswith(".") and f not in exclude and not rules.prunable((relative / f).as_posix())
        )
        for name in sorted(names):
            if _wanted(root, Path(here) / name, rules, exclude):
                yield (relative / name).as_posix()


def _wanted(root: Path, file: Path, rules: IgnoreRules, exclude: tuple[str, ...]) -> bool:
    return (
        file.suffix.lower() in D.EXTENSIONS and file.is_file() and not excluded(file, root, exclude)
        and not rules.ignored(file.relative_to(root).as_posix())
    )


def read_file(root: Path, relative: str) -> tuple:
    """One row of types.FILES; fails if the file changes while it is read or is not UTF-8."""
    path = root / relative
    try:
        before = path.stat()
        data = path.read_bytes()
        after = path.stat()
    except FileNotFoundError:
        raise ReadError(f"{relative} went while it was read; run again") from None
    if (before.st_mtime_ns, before.st_size, before.st_ino) != (after.st_mtime_ns, after.st_size, after.st_ino) or len(data) != before.st_size:
        raise ReadError(f"{relative} changed while it was read; run again")
    try:
        text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as x:
        raise ReadError(f"{relative} is not UTF-8: {x}") from None
    capture = "captured" if text.strip() else "empty"
    return (relative, path.suffix.lower(), before.st_mtime, len(data), hashlib.sha256(data).hexdigest(), capture, text)


class _Reader(DataSourceReader):
    def __init__(self, root: Path, exclude: tuple[str, ...]):
        self.root, self.exclude = root, exclude

    def partitions(self) -> list[InputPartition]:
        paths = tuple(walk(self.root, exclude=self.exclude))
        return [InputPartition(paths[at : at + FILES]) for at in range(0, len(paths), FILES)] or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for relative in partition.value:
            yield read_file(self.root, relative)


class KnowledgeBase(DataSource):
    """Options: root, and exclude as a JSON list of names."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_kb"

    def schema(self):
        return types.FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Path(self.options["root"]), tuple(json.loads(self.options.get("exclude", "[]"))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KnowledgeBase)


def files(spark: SparkSession, root: str | Path, exclude: tuple[str, ...] = ()) -> DataFrame:
    register(spark)
    return spark.read.format("lodestone_kb").option("root", str(root)).option("exclude", json.dumps(list(exclude))).load()


def capture(spark: SparkSession, root: str | Path, inventory: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The files of an inventory (path, content_sha) as they are now, in types.FILES.

    A file that is hidden, ignored or unsupported by now, or gone, is "excluded" and has no content; one whose content
    is not that of the inventory fails the job, so what is built is of one state."""
    base = Path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = IgnoreRules.load(base)
        schema = to_arrow_schema(types.FILES)
        for b in batches:
            rows = []
            for path, sha in zip(*(c.to_pylist() for c in b.columns)):
                if not _wanted(base, base / path, rules, exclude):
                    rows.append((path, Path(path).suffix.lower(), 0.0, 0, sha, "excluded", None))
                    continue
                rows.append(read_file(base, path))
                if rows[-1][4] != sha:
                    raise ReadError(f"{path} is not what the inventory says; run again")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return inventory.select("path", "content_sha").mapInArrow(run, types.FILES)


def documents(captured: DataFrame, collection: str) -> DataFrame:
    """Captured files (types.FILES) as documents (types.DOCS); front matter is read from Markdown only."""
    rows = captured.filter("capture = 'captured'")
    # front matter only where a block can be: other files never reach Python
    has = (F.col("extension") == ".md") & F.startswith(F.col("content"), F.lit("---"))
    front = F.when(has, D.front_matter(F.col("content")))
    rows = rows.withColumn("_f", front)
    text = lambda name: F.coalesce(F.col(f"_f.{name}"), F.lit(""))
    rows = rows.withColumn("_body", F.coalesce(F.col("_f.body"), F.col("content")))
    rows = rows.withColumn("title", D.title(F.col("_body"), F.col("path"), text("title")))
    return rows.select(
        F.lit(collection).alias("collection"), "path", "title", D.folder(F.col("path")).alias("folder"), "extension", "mtime",
        F.col("_body").alias("content"), F.nullif(text("summary"), F.lit("")).alias("summary"),
        D.alias_names(text("title"), F.col("_f.aliases"), F.col("title")).alias("aliases"),
        F.nullif(text("status"), F.lit("")).alias("status"), F.nullif(text("as_of"), F.lit("")).alias("as_of"),
    )


def survey(root: Path, exclude: tuple[str, ...] = ()) -> dict[str, dict[str, int]]:
    """Counts of all files by extension (visible ones) and by the reason why others are left out."""
    rules = IgnoreRules.load(root)
    seen: dict[str, dict[str, int]] = {"visible": {}, "excluded": {}}

    def add(kind: str, name: str) -> None:
        seen[kind][name] = seen[kind].get(name, 0) + 1

    for here, _, names in os.walk(root):
        for name in names:
            file = Path(here) / name
            relative = file.relative_to(root).as_posix()
            if file.suffix.lower() not in D.EXTENSIONS:
                add("excluded", "unsupported")
            elif excluded(file, root, exclude):
                add("excluded", "hidden")
            elif rules.ignored(relative):
                add("excluded", "ignored")
            else:
                add("visible", file.suffix.lower())
    return seen
