"""Layout: lines, reading order and documents from boxes.

The greedy groupings depend on the order of the boxes and on running means, which windows can't express; each is a fold over the sorted boxes of one page (bounded by the
page), inside the JVM. All take rows with page_id, pos, x1, y1, x2, y2 (and what else is named) and keep other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions.text import format_math


def folded(df: DataFrame, order: list[str], numbers, keep: list[str] | None = None, name: str = "line_no") -> DataFrame:
    """df with one more column: the fold `numbers` maps the sorted array of a page's rows to an array of values, one for each row."""
    cols = [c for c in df.columns if c != "page_id"]
    first = [c for c in order if c in cols]
    row = F.struct(*first, *[c for c in cols if c not in first])
    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zipped = pages.select("page_id", F.explode(F.arrays_zip(F.col("rows").alias("row"), numbers(F.col("rows")).alias("value"))).alias("z"))
    return zipped.select("page_id", *[F.col(f"z.row.{c}").alias(c) for c in cols], F.col("z.value").alias(name))


def with_centre(df: DataFrame) -> DataFrame:
    return df.withColumn("cy", (F.col("y1") + F.col("y2")) / 2)


def line_numbers(df: DataFrame, tolerance: float = 15) -> DataFrame:
    """line_no: a box joins the line before if its centre is within the tolerance of that line's mean centre."""

    def numbers(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("no"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, r: Column) -> Column:
            joins = (s["n"] > 0) & (F.abs(r["cy"] - s["sum"] / s["n"]) <= tolerance)
            no = F.when(joins | (s["n"] == 0), s["no"]).otherwise(s["no"] + 1)
            return F.struct(no.alias("no"), F.when(joins, s["sum"] + r["cy"]).otherwise(r["cy"]).alias("sum"), F.when(joins, s["n"] + 1).otherwise(1).alias("n"), F.concat(s["out"], F.array(no)).alias("out"))

        return F.aggregate(rows, start, step, lambda s: s["out"])

    return folded(with_centre(df), ["cy", "pos"], numbers).drop("cy")


def merge_lines(df: DataFrame, tolerance: float = 15) -> DataFrame:
    """One box around each line: page_id, line_no and corners."""
    return line_numbers(df, tolerance).groupBy("page_id", "line_no").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_boxes"))


def reading_order(df: DataFrame, tolerance: float = 20) -> DataFrame:
    """line_no, and rank: top to bottom, left to right within a line."""
    return line_numbers(df, tolerance).withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("line_no", "x1", "y1", "pos")))


def cluster_lines(df: DataFrame, overlap: float = 0.5) -> DataFrame:
    """line_no: the first line of which any box shares at least that part of the smaller height; boxes come by their centres. Lines are numbered as they are opened."""

    def numbers(rows: Column) -> Column:
        start = F.array().cast("array<struct<y1:int,y2:int,no:int>>")

        def step(out: Column, r: Column) -> Column:
            shared = lambda b: F.greatest(F.lit(0), F.least(r["y2"], b["y2"]) - F.greatest(r["y1"], b["y1"]))
            smaller = lambda b: F.least(r["y2"] - r["y1"], b["y2"] - b["y1"])
            near = F.filter(out, lambda b: (smaller(b) > 0) & (shared(b) / smaller(b) >= overlap))
            no = F.coalesce(F.array_min(F.transform(near, lambda b: b["no"])), F.array_max(F.transform(out, lambda b: b["no"])) + 1, F.lit(0))
            return F.concat(out, F.array(F.struct(r["y1"].cast("int").alias("y1"), r["y2"].cast("int").alias("y2"), no.alias("no"))))

        return F.transform(F.aggregate(rows, start, step), lambda b: b["no"])

    return folded(with_centre(df), ["cy", "pos"], numbers).drop("cy")


def merge_close(df: DataFrame, gap: int = 20) -> DataFrame:
    """Boxes of one class whose gap to the box merged so far is small become one: page_id, part, class_id, corners and the best confidence."""

    def numbers(rows: Column) -> Column:
        start = F.struct(F.lit(-1).alias("no"), F.lit(0).alias("x2"), F.lit(None).cast("int").alias("cls"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, r: Column) -> Column:
            joins = (s["no"] >= 0) & s["cls"].eqNullSafe(r["class_id"]) & (r["x1"] - s["x2"] <= gap)
            no = F.when(joins, s["no"]).otherwise(s["no"] + 1)
            return F.struct(no.alias("no"), F.when(joins, F.greatest(s["x2"], r["x2"])).otherwise(r["x2"]).cast("int").alias("x2"), r["class_id"].cast("int").alias("cls"), F.concat(s["out"], F.array(no)).alias("out"))

        return F.aggregate(rows, start, step, lambda s: s["out"])

    parts = folded(df, ["x1", "pos"], numbers, name="part")
    return parts.groupBy("page_id", "part").agg(F.first("class_id").alias("class_id"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("confidence").alias("confidence"))


def suppress(df: DataFrame, threshold: float = 0.45, least_confidence: float = 0.0) -> DataFrame:
    """Greedy suppression: by falling confidence, a box stays if it overlaps no box that stays by more than the threshold (intersection over union, whatever the class)."""
    rows = df.filter(F.col("confidence") >= least_confidence).withColumn("back", -F.col("confidence"))

    def flags(rows: Column) -> Column:
        start = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int,stays:boolean>>")

        def step(out: Column, r: Column) -> Column:
            def over(b: Column) -> Column:
                w = F.greatest(F.lit(0), F.least(r["x2"], b["x2"]) - F.greatest(r["x1"], b["x1"]))
                h = F.greatest(F.lit(0), F.least(r["y2"], b["y2"]) - F.greatest(r["y1"], b["y1"]))
                whole = (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
                return b["stays"] & (whole > 0) & (w * h / whole > threshold)

            return F.concat(out, F.array(F.struct(*[r[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], (~F.exists(out, over)).alias("stays"))))

        return F.transform(F.aggregate(rows, start, step), lambda b: b["stays"])

    return folded(rows, ["back", "pos"], flags, name="stays").filter("stays").drop("back", "stays")


def unique_regions(df: DataFrame) -> DataFrame:
    """Labelled regions with an area, one for each label and upper left corner (the first)."""
    real = df.filter((F.col("label") != "O") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return real.withColumn("n", F.row_number().over(W.partitionBy("page_id", "label", "x1", "y1").orderBy("pos"))).filter("n = 1").drop("n")


def with_page_fallback(regions: DataFrame, pages: DataFrame, label: str = "text", confidence: float = 1.0) -> DataFrame:
    """Regions, and the whole page as one for each page (page_id, width, height) that has none."""
    bare = pages.join(regions.select("page_id"), "page_id", "left_anti")  # not made distinct: regions come sorted by page, so the join has nothing to hash or sort on that side
    whole = bare.select("page_id", F.lit(label).alias("label"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").cast("int").alias("x2"), F.col("height").cast("int").alias("y2"), F.lit(1).alias("pos"), F.lit(confidence).alias("confidence"))
    return regions.unionByName(whole, allowMissingColumns=True)


def documents(df: DataFrame, title: str | None = None, paragraph: float = 2.5, line: float = 1.5) -> DataFrame:
    """(page_id, document): Markdown from rows with text, kind ('text' or 'math') and display.

    A gap of the centres above `paragraph` mean heights starts a paragraph, one above `line` a new line; display formulas stand alone, inline ones in dollar signs."""
    page = W.partitionBy("page_id")
    rows = with_centre(df).withColumn("mean_height", F.coalesce(F.avg(F.col("y2") - F.col("y1")).over(page), F.lit(30.0)))
    order = page.orderBy("cy", "pos")
    rows = rows.withColumn("gap", F.col("cy") - F.lag("cy").over(order)).withColumn("alone", (F.col("kind") == "math") & F.col("display"))
    rows = rows.withColumn("breaks", F.coalesce(F.col("gap") > F.col("mean_height") * paragraph, F.lit(False)))
    new = F.coalesce(F.col("gap") > F.col("mean_height") * line, F.lit(True)) | F.col("breaks") | F.col("alone") | F.coalesce(F.lag("alone").over(order), F.lit(False))
    rows = rows.withColumn("visual", F.sum(new.cast("int")).over(order))
    said = F.when(F.col("alone"), F.concat(F.lit("\n"), format_math(F.col("text"), F.lit(True)), F.lit("\n"))).when(F.col("kind") == "math", F.concat(F.lit("$"), F.regexp_replace("text", r"^\$+|\$+\z", ""), F.lit("$"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("x1", "cy", "pos", said.alias("said"))))
    lines = rows.groupBy("page_id", "visual").agg(F.max("breaks").alias("breaks"), F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("line"))
    lines = lines.withColumn("line", F.concat(F.when(F.col("breaks"), "\n").otherwise(""), F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("visual", "line"))), lambda v: v["line"]), "\n")
    if title:
        body = F.concat(F.lit(f"# {title}\n\n"), body)
    return lines.groupBy("page_id").agg(body.alias("document"))


def polygons_to_boxes(words: DataFrame, padding: int = 10) -> DataFrame:
    """(page_id, line_idx, text, corners) from words with corner columns px0..px3, py0..py3: by line, words in order of px0. Words without a line are dropped."""
    xs, ys = [f"px{i}" for i in range(4)], [f"py{i}" for i in range(4)]
    own = words.filter("line_idx is not null").withColumn("lx", F.least(*xs)).withColumn("hx", F.greatest(*xs)).withColumn("ly", F.least(*ys)).withColumn("hy", F.greatest(*ys))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("px0", "pos", "text"))), lambda w: w["text"]), " ")
    corner = lambda c: c.cast("int")
    return own.groupBy("page_id", "line_idx").agg(text.alias("text"), corner(F.greatest(F.lit(0), F.min("lx") - padding)).alias("x1"), corner(F.greatest(F.lit(0), F.min("ly") - padding)).alias("y1"), corner(F.max("hx") + padding).alias("x2"), corner(F.max("hy") + padding).alias("y2"))
