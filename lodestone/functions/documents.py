"""Document projections as Columns: titles, folders, cards, chunk text, breadcrumbs; front matter as a UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds that are read.
CODE_EXTENSIONS = (".sql", ".py", ".ts", ".tsx", ".yml", ".yaml")
EXTENSIONS = (*CODE_EXTENSIONS, ".md")
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def extension(path: Column) -> Column:
    """The lower-case suffix of the file name, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def _stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def heading(content: Column) -> Column:
    """The first level-one heading, or null."""
    # (?d): only \n ends a line, so other separators stay inside it
    found = F.regexp_extract(content, r"(?md)^#\s+(.+)$", 1)
    return F.when(found != "", strip(found))


def title(content: Column, path: Column, fallback: Column | None = None) -> Column:
    """Code files go by their name, Markdown by its heading, then the fallback, then the name's stem."""
    ext = extension(path)
    other = F.coalesce(F.when(fallback != "", fallback), _stem(path)) if fallback is not None else _stem(path)
    return F.when(ext.isin(*CODE_EXTENSIONS), basename(path)).when(ext == ".md", F.coalesce(heading(content), other)).otherwise(_stem(path))


def listing_title(content: Column, path: Column) -> Column:
    """As listings have it: front matter is not read, and code files go by their stem."""
    return F.when(extension(path) == ".md", F.coalesce(heading(content), _stem(path))).otherwise(_stem(path))


def alias_names(meta_title: Column, aliases: Column, title: Column) -> Column:
    """Other names of a page, each once, in order, joined."""
    names = F.concat(F.array(F.coalesce(meta_title, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: (n != "") & (F.lower(n) != F.lower(title)))), "; ")


def card(aliases: Column, summary: Column) -> Column:
    """Lead lines of a document's first chunk."""
    also = F.when(F.coalesce(aliases, F.lit("")) != "", F.concat(F.lit("Also known as: "), aliases, F.lit("\n"))).otherwise(F.lit(""))
    about = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Summary: "), summary, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(also, about)


def contextual(title: Column, folder: Column, piece: Column, lead: Column) -> Column:
    body = F.concat(F.when(lead != "", F.concat(lead, F.lit("\n"))).otherwise(F.lit("")), piece)
    return F.regexp_replace(F.concat(F.lit("Document: "), title, F.lit("\nFolder: "), folder, F.lit("\n\n"), body), r"(?U)\s+\z", "")


def breadcrumb(piece: Column, title: Column) -> Column:
    """The last three headings of a piece, or the title."""
    rows = F.transform(F.split(piece, LINE_BREAKS), strip)
    heads = F.filter(rows, lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    names = F.transform(heads, lambda x: strip(F.regexp_replace(x, r"^#{1,6}\s+", "")))
    last = F.slice(names, F.greatest(F.size(names) - 2, F.lit(1)), 3)
    return F.when(F.size(names) > 0, F.array_join(last, " > ")).otherwise(title)


FRONT = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())),
     T.StructField("status", T.StringType()), T.StructField("as_of", T.StringType()), T.StructField("body", T.StringType())]
)
_BLOCK = re.compile(r"\A---[ \t]*\n(?P<yaml>.*?)\n---[ \t]*(?:\n|\Z)", re.DOTALL)


def _one_line(value) -> str:
    return "" if value is None else " ".join(str(value).split())


def split_front_matter(content: str) -> dict:
    """Front matter fields and the body; content without a YAML mapping in front is all body."""
    import yaml

    plain = {"title": "", "summary": "", "aliases": [], "status": "", "as_of": "", "body": content}
    block = _BLOCK.match(content)
    if not block:
        return plain
    try:
        found = yaml.safe_load(block["yaml"])
    except yaml.YAMLError:
        return plain
    if not isinstance(found, dict):
        return plain
    names = found.get("aliases") or []
    names = names if isinstance(names, list) else [names]
    return {
        "title": _one_line(found.get("title") or found.get("name")),
        "summary": _one_line(found.get("summary") or found.get("description")),
        "aliases": [n for n in map(_one_line, names) if n],
        "status": _one_line(found.get("status")).lower(),
        "as_of": _one_line(found.get("as_of")),
        "body": content[block.end() :],
    }


@F.pandas_udf(FRONT)
def front_matter(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_front_matter(c or "") for c in content], columns=[f.name for f in FRONT.fields])
