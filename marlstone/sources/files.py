"""Folders of notes as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

TEXT_EXTENSIONS = ("md", "markdown", "mdx", "canvas", "txt", "text", "csv", "org", "tex")


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, with_text: bool = True) -> DataFrame:
    """path (below root), name, folder, ext, size, mtime and, if asked for, text. Hidden files and folders are left out; size and mtime filters reach the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    rel = F.substring(full, F.lit(len(root.rstrip("/")) + 2), F.length(full))
    files = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *([F.decode("content", "UTF-8").alias("text")] if with_text else []))
    files = files.withColumns({"name": T.base_name(F.col("path")), "folder": T.parent(F.col("path")), "ext": T.extension(F.col("path"))})
    hidden = F.regexp_like("path", F.lit(r"(^|/)\."))
    return files.where(~hidden & F.col("ext").isin(*extensions))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=True)


def write_parts(parts: DataFrame, path: str) -> None:
    """A text file a part, in folders by its number."""
    parts.select("part", "text").write.mode("overwrite").partitionBy("part").option("lineSep", "\n").text(path)


CANVAS = S.StructType(
    [
        S.StructField("nodes", S.ArrayType(S.StructType([S.StructField(n, S.StringType()) for n in ("id", "type", "label", "text", "file")] + [S.StructField(n, S.DoubleType()) for n in ("x", "y", "width", "height")]))),
        S.StructField("edges", S.ArrayType(S.StructType([S.StructField(n, S.StringType()) for n in ("id", "fromNode", "toNode", "label")]))),
    ]
)


def canvas_cards(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, id, type, text, group: each card with the smallest group rectangle that holds its centre. Cards without place have none."""
    nodes = df.select(F.col(key).alias("key"), F.explode(F.from_json(raw, CANVAS)["nodes"]).alias("n")).select("key", "n.*")
    cards, groups = nodes.where("type <> 'group'"), nodes.where("type = 'group'").select(F.col("key").alias("k"), F.col("label").alias("group"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("width").alias("gw"), F.col("height").alias("gh"))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (F.col("key") == F.col("k")) & cx.between(F.col("gx"), F.col("gx") + F.col("gw")) & cy.between(F.col("gy"), F.col("gy") + F.col("gh"))
    met = cards.join(groups, inside, "left")
    return met.groupBy("key", "id", "type").agg(F.first(F.coalesce("text", "file")).alias("text"), F.min_by("group", F.col("gw") * F.col("gh")).alias("group")).withColumnRenamed("key", key)
