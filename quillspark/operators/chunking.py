"""Overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import pinned


def window_bounds(n: Column, target: int, overlap: int, least_tail: int) -> Column:
    """array<struct<start, size>> of the windows over n words; a tail shorter than least_tail joins the last window.

    In closed form: window i begins at i * (target - overlap), and the last is the first whose rest, behind the
    window, is too short to stand alone.
    """
    if target < 100 or not 0 <= overlap < target:
        raise ValueError("a window has 100 words or more and overlaps by fewer than it has")
    step = target - overlap
    last = F.greatest(F.lit(0), F.ceil((n - target - max(least_tail, 1) + 1) / step)).cast("int")
    one = lambda i: F.struct((i * step).alias("start"), F.when(i == last, n - i * step).otherwise(F.lit(target)).alias("size"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one))


def with_windows(rows: DataFrame, sections: str = "sections", target: int = 400, overlap: int = 60, least_tail: int = 80) -> DataFrame:
    """rows with chunks, an array of (chunk_no, pos, section_id, level, heading, source_type, window, text, word_count) of all windows of
    an array of sections, which run through it: a paper that lies in one row needs no exchange."""

    def cut(s: Column) -> Column:
        piece = lambda at: F.array_join(F.slice(s.w, at.start + 1, at.size), " ")
        bounds = F.coalesce(window_bounds(F.size(s.w), target, overlap, least_tail), F.array().cast("array<struct<start:int,size:int>>"))
        return F.transform(bounds, lambda at, i: F.struct(s.s.section_no.alias("pos"), s.s.section_id.alias("section_id"), s.s.level.alias("level"), s.s.heading.alias("heading"), s.s.source_type.alias("source_type"), i.alias("window"), piece(at).alias("text")))

    rows = pinned(rows, __w=F.transform(sections, lambda s: F.struct(s.alias("s"), T.words(s.text).alias("w"))))
    rows = pinned(rows, __c=F.flatten(F.transform("__w", cut)))
    return pinned(rows, chunks=F.transform("__c", lambda c, i: F.struct((i + 1).cast("long").alias("chunk_no"), c.pos.alias("pos"), c.section_id.alias("section_id"), c.level.alias("level"), c.heading.alias("heading"), c.source_type.alias("source_type"), c.window.alias("window"), c.text.alias("text"), T.word_count(c.text).alias("word_count")))).drop("__w", "__c")


def windows(sections: DataFrame, target: int = 400, overlap: int = 60, least_tail: int = 80) -> DataFrame:
    """sections(paper_id, pos, text, ...) -> one row per window: chunk_no (runs through the paper), text, word_count.

    Sections are exchanged by paper before they are split, so one large file is split up by all tasks, and numbering the
    windows of a paper needs no further exchange. A paper's windows meet in one task.
    """
    rows = sections.repartition("paper_id").withColumn("__w", T.words(F.col("text"))).withColumn("__b", window_bounds(F.size("__w"), target, overlap, least_tail))
    rows = rows.select("*", F.posexplode("__b").alias("window", "__at"))
    piece = F.array_join(F.slice("__w", F.col("__at.start") + 1, F.col("__at.size")), " ")
    order = Window.partitionBy("paper_id").orderBy("pos", "window")
    rows = rows.withColumn("text", piece).withColumn("chunk_no", F.row_number().over(order).cast("long"))
    return rows.withColumn("word_count", T.word_count(F.col("text"))).drop("__w", "__b", "__at")
