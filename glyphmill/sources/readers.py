"""Readers. Paths are whatever Spark reads; nothing is opened on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "image_path string, ground_truth_text string, mode string, writer_id string, partition string, confidence double, pseudo_labeled boolean, source_page string, source_pdf string, page int"
LEXICON_LINES = "value string"


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def existing(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, stem, length) of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem"), "length")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the manifest's keys; a malformed line is an error."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image, text) from JSON arrays whose keys go by several names."""
    raw = spark.read.option("multiLine", "true").json(path)
    return _labels(raw)


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    return _labels(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))


def jsonl_labels(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(image, text); relative images stand under root."""
    raw = spark.read.json(path)
    out = raw.select(filled(*existing(raw, "image", "image_path")).alias("image"), filled(*existing(raw, "ground_truth_text", "text")).alias("text")).filter("image is not null and text is not null")
    if root:
        out = out.withColumn("image", F.when(F.col("image").startswith("/"), F.col("image")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "image")))
    return out


def _labels(raw: DataFrame) -> DataFrame:
    return raw.select(filled(*existing(raw, "image", "filename")).alias("image"), filled(*existing(raw, "text", "label", "transcription")).alias("text")).filter("image is not null and text is not null")


#: Readers by suffix.
LABELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".jsonl": jsonl_labels, ".json": json_labels, ".csv": csv_labels}


def labels(spark: SparkSession, path: str) -> DataFrame:
    for suffix, reader in LABELS.items():
        if path.endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path).filter("trim(value) <> '' and not value like '#%'")
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= least)


def iam_lines(spark: SparkSession, path: str, forms: DataFrame | None = None) -> DataFrame:
    """(line_id, form_id, writer_id, text) of lines that were segmented well; forms: (form_id) to keep, all if none is given."""
    f = _fields(spark, path, 9).filter(F.col("f")[1] == "ok")
    text = F.replace(F.array_join(F.slice("f", F.lit(9), F.size("f")), " "), F.lit("|"), F.lit(" "))
    form = F.array_join(F.slice(F.split(F.col("f")[0], "-"), 1, 2), "-")
    out = f.select(F.col("f")[0].alias("line_id"), form.alias("form_id"), F.split(F.col("f")[0], "-")[0].alias("writer_id"), text.alias("text"))
    if forms is not None and forms.limit(1).count():
        out = out.join(forms, "form_id", "left_semi")
    return out


def iam_last_fields(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, text) of the same files by the other convention: lines marked ok, the last field alone."""
    f = _fields(spark, path, 9).filter(F.col("f")[1] == "ok")
    return f.select(F.col("f")[0].alias("line_id"), F.replace(F.element_at("f", -1), F.lit("|"), F.lit(" ")).alias("text"))


def iam_words(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(word_id, line_id, text): with strict, words marked ok and their ninth field; else all but errors, and the last field."""
    f = _fields(spark, path, 9)
    f = f.filter(F.col("f")[1] == "ok") if strict else f.filter(F.col("f")[1] != "err")
    text = F.col("f")[8] if strict else F.element_at("f", -1)
    line = F.array_join(F.slice(F.split(F.col("f")[0], "-"), 1, 3), "-")
    return f.select(F.col("f")[0].alias("word_id"), line.alias("line_id"), text.alias("text")).filter("text <> ''")


def id_list(spark: SparkSession, path: str, name: str = "form_id") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(f"{name} <> '' and not {name} like '#%'")


def tab_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of two-column lines; shorter ones are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 2)
    return parts.select(F.trim(F.col("f")[0]).alias("file"), F.trim(F.col("f")[1]).alias("text")).filter("file <> ''")


def transcribed_images(spark: SparkSession, transcription: str, images: str) -> DataFrame:
    """(stem, path, writer_id, text): transcriptions that have an image; the last entry of a stem counts, blank ones are dropped."""
    lines = spark.read.text(transcription).select("value", F.monotonically_increasing_id().alias("n"))
    said = lines.select(F.split("value", "\t").alias("f"), "n").filter(F.size("f") >= 2).select(stem(F.trim(F.col("f")[0])).alias("stem"), F.trim(F.col("f")[1]).alias("text"), "n")
    last = said.groupBy("stem").agg(F.max_by("text", "n").alias("text")).filter("text <> ''")
    return listing(spark, images, "*.png").select("stem", "path").join(last, "stem").withColumn("writer_id", F.split("stem", "-")[0])


def text_files(spark: SparkSession, folder: str, images: str | None = None) -> DataFrame:
    """(stem, text) of whole .txt files, trimmed, blank ones dropped; only those with an image, if images are given."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    out = raw.select(stem(F.col("_metadata.file_path")).alias("stem"), F.trim(F.regexp_replace("value", r"^\s+|\s+\z", "")).alias("text")).filter("text <> ''")
    return out.join(listing(spark, images, "*.png").select("stem"), "stem", "left_semi") if images else out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, text): the lines of one file by their number from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), r"\r?\n")).alias("idx", "text"))


def formula_split(spark: SparkSession, path: str, formulas: DataFrame) -> DataFrame:
    """(idx, image, latex): `idx image render` rows joined with the formulas by number; numbers beyond them are dropped; images end in .png."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 2)
    rows = rows.select(F.try_to_number(F.col("f")[0], F.lit("999999999")).cast("int").alias("idx"), F.col("f")[1].alias("image"))
    image = F.when(F.col("image").endswith(".png"), F.col("image")).otherwise(F.concat("image", F.lit(".png")))
    return rows.join(formulas, "idx").select("idx", image.alias("image"), F.col("text").alias("latex"))


COCO = "categories array<struct<id:bigint,name:string>>, images array<struct<id:bigint,file_name:string>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>"


def coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, boxes): images with their boxes, named by category (`unknown` if none); images without boxes stay."""
    raw = spark.read.schema(COCO).option("multiLine", "true").json(path)
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    names = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name")
    notes = raw.select(F.posexplode("annotations").alias("pos", "a")).select("pos", "a.image_id", "a.category_id", F.col("a.bbox").alias("b"))
    corner = lambda c: c.cast("int")
    notes = notes.join(names, "category_id", "left").select("image_id", "pos", F.coalesce("name", F.lit("unknown")).alias("class_name"), corner(F.col("b")[0]).alias("x1"), corner(F.col("b")[1]).alias("y1"), corner(F.col("b")[0] + F.col("b")[2]).alias("x2"), corner(F.col("b")[1] + F.col("b")[3]).alias("y2"))
    from glyphmill.operators.manifest import with_group

    return with_group(images, notes, "image_id", ["pos", "class_name", "x1", "y1", "x2", "y2"], ["pos"], "boxes")


def ink(spark: SparkSession, folder: str) -> DataFrame:
    """(path, latex, traces) of InkML files: traces are arrays of points; unreadable points are skipped, files that are no XML have nulls."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.inkml").option("recursiveFileLookup", "true").load(folder)
    xml = F.decode("content", "utf-8")
    body = F.regexp_extract_all(xml, F.lit(r"(?s)<trace(?:\s[^>]*)?>(.*?)</trace>"), 1)
    number = lambda s, i: F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(i)).try_cast("double")
    point = lambda s: F.struct(number(s, 1).alias("x"), number(s, 2).alias("y"))
    traces = F.transform(body, lambda t: F.filter(F.transform(F.split(t, ","), point), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    truth = F.regexp_extract(xml, r"(?s)<annotation\s+type\s*=\s*[\"']truth[\"'][^>]*>(.*?)</annotation>", 1)
    whole = xml.rlike(r"(?s)</ink>\s*\z")
    return raw.select("path", F.when(whole & (truth != ""), F.trim(truth)).alias("latex"), F.when(whole, traces).alias("traces"))


POLYGONS = "line_idx int, text string, polygon struct<x0:double,y0:double,x1:double,y1:double,x2:double,y2:double,x3:double,y3:double>"


def word_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, pos, line_idx, text, px0..py3) of JSON files of words; page_id is the file's stem."""
    raw = spark.read.schema(POLYGONS).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    rows = raw.select(stem(F.col("_metadata.file_path")).alias("page_id"), "line_idx", "text", *[F.col(f"polygon.{a}{i}").alias(f"p{a}{i}") for i in range(4) for a in "xy"])
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("page_id").orderBy("line_idx", "px0", "py0", "text")))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word) from a JSON list, a JSON object with `words`, or one word on each line."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<words:array<string>>")["words"])
        raw = whole.select(F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(listed)).alias("word"))
    else:
        raw = spark.read.text(path).select(F.col("value").alias("word"))
    return raw.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()


def formula_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(text) of .txt and .tex files line by line, and of the formula keys of .json and .jsonl files; unreadable lines are skipped."""
    plain = spark.read.option("pathGlobFilter", "*.{txt,tex}").option("recursiveFileLookup", "true").text(folder).select(F.col("value").alias("text"))
    keyed = spark.read.schema("ground_truth_text string, latex string, formula string").option("pathGlobFilter", "*.{json,jsonl}").option("recursiveFileLookup", "true").json(folder)
    return plain.union(keyed.select(filled(F.col("ground_truth_text"), F.col("latex"), F.col("formula")).alias("text"))).filter("text is not null")


def images(spark: SparkSession, folder: str, skip_unreadable: bool = False) -> DataFrame:
    """(origin, height, width, channels, data) of pictures; height is -1 where one can't be decoded, unless those are skipped."""
    raw = spark.read.format("image").option("dropInvalid", str(skip_unreadable).lower()).option("recursiveFileLookup", "true").load(folder)
    return raw.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(checkpoint): folders that hold weights."""
    files = listing(spark, folder).filter(F.col("name").rlike(r"\.(bin|safetensors|onnx)$"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("checkpoint")).distinct().orderBy("checkpoint")


def sample(df: DataFrame, idx: int, column: str = "idx") -> DataFrame:
    """One sample by number; IndexError if there is none."""
    found = df.filter(F.col(column) == idx)
    if found.limit(1).count() == 0:
        raise IndexError(idx)
    return found


def first_available(spark: SparkSession, candidates: dict[str, list[str]]) -> DataFrame:
    """(name, path): the first of each data set's candidate paths that exists, else null; a bounded list of names."""
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    rows = [(name, next((p for p in paths if there(p)), None)) for name, paths in sorted(candidates.items())]
    return spark.createDataFrame(rows, "name string, path string")


def result(results: DataFrame, job_id: str) -> DataFrame:
    """One job's result; KeyError for an unknown job."""
    found = results.filter(F.col("job_id") == job_id)
    if found.limit(1).count() == 0:
        raise KeyError(job_id)
    return found


#: What turns a document's bytes into pages: (picture bytes, text) of each.
Renderer = Callable[[bytes], list[tuple[bytes, str]]]


def document_pages(spark: SparkSession, folder: str, factory: Callable[[], Renderer], most: int | None = None, pattern: str = "*.pdf") -> DataFrame:
    """(path, page, image, text, mode, error): the pages of documents by a renderer that is made once in each task; `most` bounds the pages of a document.

    mode is pdf_page, or needs_labeling where a page has no text; a document that can't be rendered is one row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = factory()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    pages = [(n, image, (text or "").strip(), None) for n, (image, text) in enumerate(render(content)[:most], 1)]
                except Exception as e:  # noqa: BLE001  a failed document is a row
                    pages = [(0, None, "", f"{type(e).__name__}: {e}")]
                if pages:
                    n, image, text, error = zip(*pages, strict=True)
                    modes = ["pdf_page" if t else "needs_labeling" for t in text]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(n)), pa.array(n, pa.int32()), pa.array(image, pa.binary()), pa.array(text, pa.string()), pa.array(modes), pa.array(error, pa.string())], ["path", "page", "image", "text", "mode", "error"])

    return files.mapInArrow(run, "path string, page int, image binary, text string, mode string, error string")


class Loader:
    """A source to be filled in by others: override `load`; `manifest` gives its rows with the manifest's keys."""

    name = "loader"

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def manifest(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).select("image_path", "ground_truth_text", "mode").withColumn("partition", F.lit(self.name))
