"""Structure of documents from their ordered lines: divisions, groups, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def so_far():
    return in_doc().rowsBetween(Window.unboundedPreceding, 0)


def carried_divisions(units: DataFrame, chapter_every: str, section_every: str) -> DataFrame:
    """Chapter and section of every line: the latest heading, where a new chapter ends the section."""
    marked = units.withColumn("chapter_head", F.when(F.expr(chapter_every), F.col("pos"))).withColumn("section_head", F.when(F.expr(section_every), F.col("pos")))
    chapter = F.last("chapter_head", ignorenulls=True).over(so_far())
    with_chapter = marked.withColumn("chapter", chapter)
    section = F.last("section_head", ignorenulls=True).over(Window.partitionBy("doc_id", "chapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return with_chapter.withColumn("section", section)


def sessionized(units: DataFrame, heading: str) -> DataFrame:
    """Lines grouped under the latest heading: group number, heading line and lines of the group."""
    group = F.sum(F.when(F.expr(heading), 1).otherwise(0)).over(so_far())
    return units.withColumn("grp", group).where("grp > 0").groupBy("doc_id", "grp").agg(F.min("pos").alias("heading_pos"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def header_changes(divided: DataFrame) -> DataFrame:
    """Lines whose chapter differs from that of the line before."""
    before = F.lag("chapter").over(in_doc())
    return divided.withColumn("before", before).where("chapter is not null and (before is null or before <> chapter)").select("doc_id", "pos", "chapter")


def neighbours(units: DataFrame) -> DataFrame:
    return units.select("doc_id", "pos", F.lag("pos").over(in_doc()).alias("prev_pos"), F.lead("pos").over(in_doc()).alias("next_pos"))


def batches(units: DataFrame, size: int = 35) -> DataFrame:
    number = F.floor((F.row_number().over(in_doc()) - 1) / size)
    return units.withColumn("batch", number).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def toc(divided: DataFrame) -> DataFrame:
    """Items of every (chapter, section) in first-seen order."""
    items = divided.groupBy("doc_id", "chapter", "section").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("items"))
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos")))


def aligned(units: DataFrame, one: str, other: str, key: list[str]) -> DataFrame:
    """Units of one language with those of the other at the same place."""
    left, right = units.where(F.col("lang") == one), units.where(F.col("lang") == other)
    return left.select(*key, F.length("text").alias("chars")).join(right.select(*key, F.length("text").alias("other_chars")), key, "left")
