"""Words on a page: running offsets, separators, lines, and the words that entities cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<text:string,x0:double,y0:double,x1:double,y1:double,char_start:int,char_end:int>"


def read_words(words: DataFrame) -> DataFrame:
    """doc_id, page_num, ord, text, sep, char_start, char_end of recognised words (with block, line, conf).

    Empty words and those of negative confidence go. A new block is set off by a blank line, a new line by a line
    feed, other words by a space.
    """
    w = Window.partitionBy("doc_id", "page_num").orderBy("ord")
    x = words.withColumn("text", F.trim("text")).filter("text <> '' AND conf >= 0")
    x = x.withColumn("pb", F.lag("block").over(w)).withColumn("pl", F.lag("line").over(w))
    x = x.withColumn("sep", F.when(F.col("pb").isNull(), "").when(F.col("pb") != F.col("block"), "\n\n").when(F.col("pl") != F.col("line"), "\n").otherwise(" "))
    so_far = F.sum(F.length("sep") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("doc_id", "page_num", "ord", "text", "sep", (so_far - F.length("text")).alias("char_start"), so_far.alias("char_end"))


def read_text(words: DataFrame) -> DataFrame:
    per = read_words(words).groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("ord", "sep", "text"))).alias("w"))
    return per.select("doc_id", "page_num", F.array_join(F.transform("w", lambda x: F.concat(x["sep"], x["text"])), "").alias("text"))


def line_words(lines: DataFrame) -> DataFrame:
    """Word boxes of recognised lines (doc_id, page_num, ord, text, x0, y0, x1, y1): a line's width is dealt out by
    the share of its characters."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("base", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).withColumn("n", F.length("text"))
    x = x.select("*", F.posexplode(F.split("text", " ")).alias("k", "word"))
    v = Window.partitionBy("doc_id", "page_num", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.coalesce(F.sum(F.length("word") + 1).over(v), F.lit(0))).filter("word <> ''")
    width = (F.col("x1") - F.col("x0")) / F.col("n")
    return x.select("doc_id", "page_num", "ord", "k", F.col("word").alias("text"), (F.col("x0") + width * F.col("at")).alias("x0"), "y0", (F.col("x0") + width * (F.col("at") + F.length("word"))).alias("x1"), "y1", (F.col("base") + F.col("at")).alias("char_start"), (F.col("base") + F.col("at") + F.length("word")).alias("char_end"))


def percent_boxes(words: DataFrame) -> DataFrame:
    """Boxes in percent of the page (width, height); blank words go but keep their place in the numbering."""
    x = words.withColumn("text", F.trim("text")).filter("text <> ''")
    return x.select("doc_id", "page_num", "index", "text", (F.col("x0") / F.col("width") * 100).alias("x_pct"), (F.col("y0") / F.col("height") * 100).alias("y_pct"), ((F.col("x1") - F.col("x0")) / F.col("width") * 100).alias("w_pct"), ((F.col("y1") - F.col("y0")) / F.col("height") * 100).alias("h_pct"))


def covered_boxes(ents: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes whose characters an entity's overlap: an equi-join on the page, then the ranges."""
    e = ents.select("doc_id", "page_num", F.col("entity").alias("entity"), F.col("start"), F.col("end"))
    return e.join(boxes, ["doc_id", "page_num"]).filter("char_start < end AND char_end > start")


def line_rects(boxes: Column) -> Column:
    """Rectangles of lines: boxes by (y0, x0); a box joins the line whose first box starts less than half its own
    height away."""
    none = F.array().cast("array<struct<y:double,x0:double,y0:double,x1:double,y1:double>>")

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.abs(b["y0"] - last["y"]) < (b["y1"] - b["y0"]) * 0.5)
        own = F.struct(b["y0"].alias("y"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
        both = F.struct(last["y"].alias("y"), F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(own)))

    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"))))
    return F.aggregate(ordered, none, step)


def entity_rects(ents: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_num, entity, line, x0, y0, x1, y1."""
    per = covered_boxes(ents, boxes).groupBy("doc_id", "page_num", "entity").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
    x = per.select("doc_id", "page_num", "entity", F.posexplode(line_rects(F.col("b"))).alias("line", "r"))
    return x.select("doc_id", "page_num", "entity", "line", "r.x0", "r.y0", "r.x1", "r.y1")


def words_of_entities(words: DataFrame, rects: DataFrame, approved: DataFrame) -> DataFrame:
    """doc_id, page_num, index, entity, redacted: the first entity whose rectangle holds a word's centre."""
    r = rects.select("doc_id", "page_num", "entity", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = words.join(r, ["doc_id", "page_num"]).filter(cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1")))
    first = held.groupBy("doc_id", "page_num", "index").agg(F.min("entity").alias("entity"))
    return first.join(approved, ["doc_id", "entity"]).select("doc_id", "page_num", "index", "entity", F.col("approved").alias("redacted"))


def text_positions(pages: DataFrame, wanted: Column) -> DataFrame:
    """doc_id, page_num, start, end of every place of a text on a page, upper and lower case alike; places do not overlap."""
    parts = F.split(F.lower("text"), F.concat(F.lit("\\Q"), F.replace(F.lower(wanted), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    n = F.length(wanted)
    x = pages.withColumn("n", n).filter("n > 0").withColumn("parts", parts).filter("size(parts) > 1")
    x = x.select("doc_id", "page_num", "n", F.posexplode(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), F.length)).alias("i", "length"))
    so_far = F.sum("length").over(Window.partitionBy("doc_id", "page_num").orderBy("i"))
    return x.withColumn("start", (so_far + F.col("i") * F.col("n")).cast("int")).select("doc_id", "page_num", "start", (F.col("start") + F.col("n")).alias("end"))
