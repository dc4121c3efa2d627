"""Further registered queries: formats written and read back, chains of steps, and summaries, each over a whole table and with its oracle.

Files go to the shared folder under a name of their own for each query and input, and replace those of an earlier run."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import confidence as C
from glyphmill.functions import distance as D
from glyphmill.functions import geometry as G
from glyphmill.functions import routing as R
from glyphmill.functions import text as X
from glyphmill.operators import documents, layout, lexicon, lines, manifest, metrics, spelling
from glyphmill.plans.catalogue import ARTIFACTS, BOXES, CER, FOLD, LEX, PAIRS, TOKEN_EDITS, WER, S, benchmark_words, boxes, formula_pairs, latex_lines, LATEX_SQL, pairs, q, query, strip_markup_sql, strip_sql, symbols_sql, words_sql
from glyphmill.session import shared_folder, table
from glyphmill.sources import readers, writers
from glyphmill.streaming import logs


def place(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark)}/files/{zlib.crc32(sf_dir.encode()):08x}-{name}"


def concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- formats ----------------------------------------------------------------------------------------------------------


@query("SELECT 'd/' || doc_id || '.png' AS image_path, text AS ground_truth_text, lang AS mode FROM documents")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "manifest")
    rows = table(spark, sf_dir, "documents").select(concat("d/", F.col("doc_id"), ".png").alias("image_path"), F.col("text").alias("ground_truth_text"), F.col("lang").alias("mode"))
    writers.manifest(rows, path)
    return readers.manifest(spark, path).select("image_path", "ground_truth_text", "mode")


@query("SELECT kind, image, text FROM (SELECT unnest(['json', 'csv', 'jsonl']) AS kind, n_name || '.png' AS image, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'the text, \"' || n_nationkey || '\"' END AS text FROM nation) WHERE text <> ''")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(concat(F.col("n_name"), ".png").alias("filename"), F.when(k % 4 == 0, "").otherwise(concat('the text, "', k, '"')).alias("label"))
    paths = {kind: place(spark, sf_dir, f"labels.{kind}") for kind in ("json", "csv", "jsonl")}
    writers.lines(rows.coalesce(1).agg(F.to_json(F.collect_list(F.struct("filename", "label"))).alias("value")), paths["json"])
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(paths["csv"])
    writers.json_rows(rows.select(F.col("filename").alias("image"), F.col("label").alias("text")), paths["jsonl"])
    return manifest.union_all(*[readers.labels(spark, path).select(F.lit(kind).alias("kind"), "image", "text") for kind, path in paths.items()])


IAM = "SELECT 'a' || l_suppkey % 7 || '-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_partkey % 5 = 0 THEN 'err' ELSE 'ok' END AS status, l_orderkey AS o, l_suppkey % 7 AS s, l_partkey AS p FROM lineitem"


@query(f"SELECT 'line' AS kind, id, 'w' || p || ' x end' AS text FROM ({IAM}) WHERE status = 'ok' AND o % 3 <> 0 UNION ALL SELECT 'last', id, 'end' FROM ({IAM}) WHERE status = 'ok' UNION ALL SELECT 'word', id, 'w' || p || '|x' FROM ({IAM}) WHERE status = 'ok' UNION ALL SELECT 'loose', id, 'end' FROM ({IAM}) WHERE status <> 'err'")
def iam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ids = place(spark, sf_dir, "iam"), place(spark, sf_dir, "forms")
    form = concat("a", F.col("l_suppkey") % 7, "-", F.col("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_partkey") % 5 == 0, "err").otherwise("ok")
    value = F.concat_ws(" ", concat(form, "-", F.col("l_linenumber")), status, F.lit("154 408 768 27 51 AT"), concat("w", F.col("l_partkey"), "|x"), F.lit("end"))
    head = spark.createDataFrame([("# id status",), ("",)], "value string")
    writers.lines(head.union(rows.select(value)), path)
    writers.lines(head.union(rows.filter("l_orderkey % 3 <> 0").select(form).distinct()), ids)
    every = [readers.iam_lines(spark, path, readers.id_list(spark, ids)).select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), "text"), readers.iam_last_fields(spark, path).select(F.lit("last").alias("kind"), F.col("line_id").alias("id"), "text")]
    every += [readers.iam_words(spark, path, strict).select(F.lit(kind).alias("kind"), F.col("word_id").alias("id"), "text") for kind, strict in (("word", True), ("loose", False))]
    return manifest.union_all(*every)


@query("SELECT 'c-' || c_custkey || '.png' AS file, c_name AS text FROM customer UNION ALL SELECT 's-' || s_suppkey || '.png', s_name FROM supplier")
def tab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "tabs")
    c = table(spark, sf_dir, "customer").select(concat("c-", F.col("c_custkey"), ".png").alias("file"), F.col("c_name").alias("latex"))
    s = table(spark, sf_dir, "supplier").select(concat("s-", F.col("s_suppkey"), ".png").alias("file"), F.col("s_name").alias("latex"))
    writers.lines(spark.createDataFrame([("a short line",)], "value string"), path)  # replaces an earlier run's
    writers.tab_pairs(c, path)
    writers.tab_pairs(s, path)
    return readers.tab_pairs(spark, path)


ONE_LINE = r"trim(regexp_replace(text, '[\r\n]+', ' ', 'g'))"


@query(f"WITH f AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, {ONE_LINE} AS latex FROM benchmark) SELECT CAST(idx AS INT) AS idx, 'e' || event_id || '.png' AS image, latex FROM events JOIN f ON event_id % (SELECT count(*) + 20 FROM benchmark) = idx")
def formula_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, split = place(spark, sf_dir, "formulas"), place(spark, sf_dir, "formula-split")
    said = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"[\r\n]+", " ")).alias("value"))
    writers.lines(said.coalesce(1).sortWithinPartitions("item_id"), path)  # the format is one file whose line numbers count
    n, e = said.count() + 20, F.col("event_id")
    writers.lines(table(spark, sf_dir, "events").select(F.concat_ws(" ", (e % n).cast("string"), F.when(e % 2 == 0, concat("e", e)).otherwise(concat("e", e, ".png")), F.lit("basic")).alias("value")), split)
    return readers.formula_split(spark, split, readers.numbered_lines(spark, path))


@query("SELECT n_nationkey AS image_id, n_name || '.jpg' AS file_name, count(s_suppkey) AS n_boxes, coalesce(string_agg(CASE WHEN s_suppkey % 4 < 3 THEN 'kind' || s_suppkey % 4 ELSE 'unknown' END || ':' || s_suppkey % 50 || ',' || s_suppkey % 40 || ',' || s_suppkey % 50 + 30 || ',' || s_suppkey % 40 + 12, ' ' ORDER BY s_suppkey), '') AS boxes FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def coco_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, s = place(spark, sf_dir, "coco"), F.col("s_suppkey")
    images = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), concat(F.col("n_name"), ".jpg").alias("file_name")))).alias("images"))
    box = F.array((s % 50).cast("double"), (s % 40).cast("double"), F.lit(30.6), F.lit(12.0))
    notes = table(spark, sf_dir, "supplier").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_nationkey").alias("image_id"), (s % 4).alias("category_id"), box.alias("bbox")))), lambda a: F.struct(a["image_id"].alias("image_id"), a["category_id"].alias("category_id"), a["bbox"].alias("bbox"))).alias("annotations"))
    kinds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"kind{i}").alias("name")) for i in range(3)])
    writers.json_rows(images.crossJoin(notes).select(kinds.alias("categories"), "images", "annotations"), path)  # the format is one document
    told = F.transform("boxes", lambda b: concat(b["class_name"], ":", b["x1"], ",", b["y1"], ",", b["x2"], ",", b["y2"]))
    return readers.coco(spark, path).select("image_id", "file_name", F.size("boxes").cast("bigint").alias("n_boxes"), F.array_join(told, " ").alias("boxes"))


@query(f"SELECT word FROM {LEX}")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "lexicon.json")
    writers.lexicon(benchmark_words(spark, sf_dir), path)
    return readers.lexicon(spark, path)


@query("SELECT line, count(*) AS n FROM (SELECT format('[+{:.3f}s] {} {}: ', epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)), CASE WHEN event_id % 9 = 0 THEN 'WARNING' ELSE 'INFO' END, event_type) || user_id AS line FROM events) GROUP BY 1")
def log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "log")
    rows = lines.log_elapsed(table(spark, sf_dir, "events"), "user_id", "ts", places=None)
    rows = rows.select("elapsed", F.when(F.col("event_id") % 9 == 0, "warning").otherwise("info").alias("level"), F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("message"))
    writers.lines(writers.log_lines(rows), path, "line")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n <= floor(a * 0.9 + 1e-9) THEN 'train' WHEN n <= floor(a * 0.9 + 1e-9) + floor(a * 0.05 + 1e-9) THEN 'val' ELSE 'test' END AS partition, image_path FROM (SELECT image_path, row_number() OVER (ORDER BY md5(image_path || ':42'), image_path) AS n, count(*) OVER () AS a FROM (SELECT 'd' || doc_id AS image_path FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark))")
def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "training")
    d = table(spark, sf_dir, "documents").select(concat("d", F.col("doc_id")).alias("image_path"), F.col("text").alias("ground_truth_text"), "lang")
    writers.training_manifest([d, table(spark, sf_dir, "benchmark").select(concat("b", F.col("item_id")).alias("image_path"), F.col("text").alias("ground_truth_text"))], path)
    return spark.read.schema("image_path string, ground_truth_text string, lang string, partition string").json(path).select("partition", "image_path")


@query("SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || coalesce(source, 'none') || chr(10) || '---' || chr(10) || chr(10) || substr(text, 1, 500) AS document FROM documents WHERE text IS NOT NULL")
def front_matter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, sf_dir, "front-matter")
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    facts = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.coalesce("source", F.lit("none")))
    writers.json_rows(rows.select("doc_id", documents.front_matter(F.substring("text", 1, 500), facts).alias("document")), path)
    return spark.read.schema("doc_id bigint, document string").json(path)


# --- chains of steps --------------------------------------------------------------------------------------------------

SLIPPED = r"regexp_replace(text, '\bth', 'tx', 'g')"


@query(
    f"""WITH lex AS {LEX}, t AS (SELECT item_id, {words_sql(SLIPPED)} AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS whole, generate_subscripts(w, 1) AS pos FROM t), p AS (SELECT *, lower(regexp_replace(whole, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]', '', 'g')) AS query FROM u),
s AS (SELECT DISTINCT query FROM p WHERE length(query) >= 3 AND NOT regexp_matches(query, '^\\p{{Nd}}+$') AND query NOT IN (SELECT word FROM lex) AND query NOT LIKE 'txe%'), n AS (SELECT query, arg_min(word, (levenshtein({FOLD('query')}, word), word)) AS best FROM s JOIN lex ON abs(length(query) - length(word)) <= 2 AND levenshtein({FOLD('query')}, word) <= 2 GROUP BY 1)
SELECT item_id, string_agg(CASE WHEN best IS NULL THEN whole WHEN upper(whole[1]) = whole[1] AND lower(whole[1]) <> whole[1] THEN upper(best[1]) || substr(best, 2) ELSE best END, ' ' ORDER BY pos) AS corrected, count(best) AS corrections FROM p LEFT JOIN n USING (query) GROUP BY 1"""
)
def spell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"\bth", "tx").alias("text"))
    domain = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(?<![\p{L}\p{N}\p{M}\p{Pc}])(txe[\p{L}\p{N}\p{M}\p{Pc}]*)"), 1)).alias("word"))
    return spelling.correct_words(texts, benchmark_words(spark, sf_dir), "item_id", domain)


MARKED = strip_markup_sql("cleaned")


@query(f"SELECT doc_id, {MARKED} AS text, cleaned <> text AS artifacts_removed, {MARKED} <> cleaned AS latex_cleaned, false AS math_normalized, 0 AS corrections FROM (SELECT doc_id, text, {ARTIFACTS} AS cleaned FROM documents WHERE text IS NOT NULL)")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.post_process(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", markup=True)


@query(
    f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS was, {ARTIFACTS.replace("(text,", "(coalesce(text, ''),")} AS now FROM conversations), l AS (SELECT * FROM c WHERE now <> ''), e AS (SELECT *, CASE WHEN lag(now) OVER w IS NULL OR regexp_matches(lag(now) OVER w, '[.!?:;]$') THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_lines, CAST(sum(CAST(was <> now AS INT)) AS BIGINT) AS artifacts, CAST(count(*) - sum(fresh) AS BIGINT) AS merged FROM e GROUP BY 1"""
)
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.process_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"SELECT doc_id, CASE WHEN asked THEN 'read: ' || ruled ELSE ruled END AS corrected, asked FROM (SELECT *, length(ruled) > 5 AND contains(ruled, '\\') AND NOT contains(ruled, '?') AS asked FROM (SELECT doc_id, {symbols_sql('latex')} AS ruled FROM {LATEX_SQL}))")
def symbol_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    def model(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.select(key, F.concat(F.lit("read: "), text).alias("reply"))

    return spelling.symbol_chain(latex_lines(spark, sf_dir).filter("not latex like '%???%'"), "doc_id", "latex", model).unionByName(spelling.symbol_chain(latex_lines(spark, sf_dir).filter("latex like '%???%'"), "doc_id", "latex"))


REPLIES = ["```json\n[\"a\", \"b\"]\n```", " ```x```", "It is Calculus, I think", "geometry and algebra", "no idea"]


@query("SELECT event_id, " + strip_sql(f"regexp_replace({strip_sql('r')}, '^```(?:json)?|```$', '', 'g')") + " AS bare, CASE WHEN contains(lower(r), 'algebra') THEN 'algebra' WHEN contains(lower(r), 'calculus') THEN 'calculus' WHEN contains(lower(r), 'geometry') THEN 'geometry' ELSE 'unknown' END AS problem, CASE WHEN event_id % 2 = 0 THEN r ELSE event_type END AS label FROM (SELECT *, [" + ", ".join("'" + q(r).replace("\n", "' || chr(10) || '") + "'" for r in REPLIES) + f"][event_id % {len(REPLIES)} + 1] AS r FROM events)")
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    r = F.element_at(F.array(*[F.lit(x) for x in REPLIES]), (e % len(REPLIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", r.alias("r"))
    return rows.select("event_id", X.strip_fences(F.col("r")).alias("bare"), X.problem_class(F.col("r")).alias("problem"), X.label_of(F.when(e % 2 == 0, F.col("r")).otherwise(concat("$", F.col("event_type"), "$"))).alias("label"))


@query("SELECT conv_id, string_agg('Block ' || n || ' [' || role || ']: ' || text, chr(10) ORDER BY n) || chr(10) AS prompt FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations WHERE text IS NOT NULL) GROUP BY 1")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.linearized(table(spark, sf_dir, "conversations").filter("text is not null"), "conv_id", "turn", "text", "role")


# --- summaries and lookups --------------------------------------------------------------------------------------------


@query(f"SELECT checkpoint, round(avg({WER}) FILTER (ok), 6) AS mean_token_distance, round(avg(CAST(regexp_replace(prediction, '{S}+', '', 'g') = regexp_replace(reference, '{S}+', '', 'g') AS INT)) FILTER (ok), 6) AS mean_exact, count_if(ok) AS num_evaluated FROM (SELECT *, 'c' || conv_id % 4 AS checkpoint, conv_id % 4 <> 3 AND turn % 5 <> 0 AS ok FROM ({TOKEN_EDITS})) GROUP BY 1")
def checkpoint_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formula_pairs(spark, sf_dir).withColumn("checkpoint", concat("c", F.col("conv_id") % 4))
    ok = (F.col("conv_id") % 4 != 3) & (F.col("turn") % 5 != 0)
    out = metrics.checkpoint_means(rows.withColumn("prediction", F.when(ok, F.col("prediction"))), "math")
    return out.select("checkpoint", F.round("mean_token_distance", 6).alias("mean_token_distance"), F.round("mean_exact", 6).alias("mean_exact"), "num_evaluated")


@query(f"SELECT round(avg(round(c, 4)), 4) AS mean_cer, round(coalesce(stddev_samp(round(c, 4)), 0), 4) AS std_cer, count(*) AS n FROM (SELECT {CER} AS c FROM ({PAIRS}))")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pairs(spark, sf_dir).select(D.cer(F.col("prediction"), F.col("reference")).alias("cer"), F.lit(0.0).alias("wer"))
    return metrics.batch_summary(rated).select("mean_cer", "std_cer", "n")


@query("SELECT count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count_if(event_type = 'purchase') AS purchase FROM events")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts_of(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"])


@query("SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NOT NULL THEN n ELSE 0 END AS n, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey END AS nation FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    a = c.select(F.col("c_custkey").alias("k"), F.create_map(F.lit("n"), F.lit(0).cast("bigint"), F.lit("nation"), F.col("c_nationkey").cast("bigint")).alias("metrics"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.create_map(F.lit("n"), F.count(F.lit(1))).alias("metrics"))
    return metrics.merged_metrics(a, b, "k").select("k", F.col("metrics")["n"].alias("n"), F.col("metrics")["nation"].cast("int").alias("nation"))


REGIONS = f"SELECT page_id, pos, x1, y1, x2, y2, CASE WHEN class_id = 0 THEN 'O' ELSE 'text' END AS label FROM ({BOXES})"


@query(f"WITH r AS (SELECT page_id, label, x1, y1, min(pos) AS pos FROM ({REGIONS}) WHERE label <> 'O' AND x2 > x1 AND y2 > y1 GROUP BY 1, 2, 3, 4), u AS (SELECT r.page_id, r.pos, r.x1, r.y1, b.x2, b.y2 FROM r JOIN ({REGIONS}) b ON r.page_id = b.page_id AND r.pos = b.pos) SELECT * FROM u UNION ALL SELECT o_orderkey, 1, 0, 0, 640, 800 FROM orders WHERE o_orderkey NOT IN (SELECT page_id FROM u)")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("page_id", "pos", "x1", "y1", "x2", "y2", F.when(F.col("class_id") == 0, "O").otherwise("text").alias("label"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(640).alias("width"), F.lit(800).alias("height"))
    return layout.with_page_fallback(layout.unique_regions(rows), pages).select("page_id", "pos", "x1", "y1", "x2", "y2")


@query("SELECT event_id, CASE WHEN engine = 'mathpix' THEN 'trocr' WHEN engine IN ('trocr', 'arithmetic') AND event_id % 3 = 0 THEN 'mathpix' ELSE engine END AS engine FROM (SELECT event_id, ['mathpix', 'trocr', 'arithmetic'][event_id % 3 + 1] AS engine FROM events)")
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    engine = F.element_at(F.array(*[F.lit(x) for x in ("mathpix", "trocr", "arithmetic")]), (e % 3 + 1).cast("int"))
    there = F.when(e % 3 == 0, F.array(F.lit("trocr"), F.lit("mathpix"))).otherwise(F.array(F.lit("trocr")))
    return table(spark, sf_dir, "events").select("event_id", R.fallback(engine, there).alias("engine"))


@query(f"SELECT doc_id, round(1.0 / len(list_distinct(w[1:3])), 6) AS agreement FROM (SELECT doc_id, {words_sql('lower(text)')} AS w FROM documents) WHERE len(w) > 0")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", D.words(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", F.round(C.agreement(F.col("w")), 6).alias("agreement"))


@query("SELECT 'text' AS kind, doc_id AS id, false AS display, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM documents UNION ALL SELECT 'math', item_id, item_id % 2 = 0, 0.9 FROM benchmark")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 != 0, 0.5).alias("confidence"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("latex"), F.when(F.col("item_id") % 2 == 0, True).alias("display"))
    return manifest.merge_results(d, b).select("kind", "id", "display", "confidence")


@query("SELECT page_id, pos, x1 AS ax1, y1 + x2 AS ay2, greatest(0, least(640, CAST(trunc((x1 - x2 / 2 - 10) / 2.0) AS INT))) AS bx1, greatest(0, least(800, CAST(trunc((y1 + y2 / 2 - 4) / 2.0) AS INT))) AS by2 FROM (" + BOXES + ")")
def detector_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    a = G.from_corner_size(F.array(x1, y1, y2, x2))
    b = G.from_centre(x1, y1, x2, y2, F.lit(2.0), F.lit(10), F.lit(4), F.lit(640), F.lit(800))
    return boxes(spark, sf_dir).select("page_id", "pos", a["x1"].alias("ax1"), a["y2"].alias("ay2"), b["x1"].alias("bx1"), b["y2"].alias("by2"))


@query("SELECT event_id AS job_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'completed' ELSE 'failed' END WHEN event_id % 3 = 0 THEN CASE WHEN value > 60 THEN 'failed' ELSE 'processing' END ELSE 'queued' END AS state FROM events")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("job_id", F.col("event_id"))
    started = e.filter("event_id % 3 = 0").select("job_id", F.col("value").alias("seconds"))
    done = e.filter("event_id % 4 = 0").select("job_id", F.when(F.col("event_id") % 8 != 0, "no picture").alias("error"))
    return logs.job_states(e, started, done, 60.0)


@query("SELECT sha256(text) AS sha FROM documents WHERE text IS NOT NULL GROUP BY 1")
def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_requests(table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha"))).select("sha")


@query(f"SELECT DISTINCT lower(word) AS word FROM (SELECT word FROM {LEX} UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation) WHERE word <> ''")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lexicon(benchmark_words(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_name").alias("word")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")))


@query("SELECT conv_id, turn, a.text AS first, b.text AS second FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS pos FROM conversations) a JOIN (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS pos, upper(role) AS text FROM conversations) b USING (pos)")
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    per = c.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    pos = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("n").cast("string"))  # a place that needs no single ordering task
    rows = per.withColumn("pos", pos)
    return manifest.checked_zip(rows.select("pos", "conv_id", "turn", F.col("text").alias("first")), rows.select("pos", F.upper("role").alias("second")), "pos").select("conv_id", "turn", "first", "second")
