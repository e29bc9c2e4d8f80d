"""Notes in Markdown: front-matter, sections, links, and the links table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from .readers import whole_text

LINK = r"\[\[([^\]|#]+)"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """``id, path, title, front, body`` of the notes in ``folder``; the id is the slug of the file's name."""
    files = whole_text(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)\.md\z", 1)
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    return files.select(F.concat(F.lit("note:"), slug(name)).alias("id"), "path", name.alias("title"), front.alias("front"), body.alias("body"))


def links(found: DataFrame) -> DataFrame:
    """``src, dst, kind`` between notes that exist."""
    out = found.select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(LINK), F.lit(1))).alias("to"))
    out = out.select("src", F.concat(F.lit("note:"), slug(F.trim("to"))).alias("dst"), F.lit("links").alias("kind")).distinct()
    return out.join(found.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


def backlinks(edges: DataFrame, ident: str) -> DataFrame:
    return edges.filter((F.col("dst") == ident) & (F.col("kind") == "links")).select(F.col("src").alias("id"))
