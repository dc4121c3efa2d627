"""All registered queries of the recognition engine and their oracle SQL.

The tables stand for recognition output: documents and conversations are recognized lines, neighbouring turns are pairs of prediction and reference, lineitem holds
boxes and numbers, embeddings logits, events a processing log. Every query runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import arithmetic as A
from glyphmill.functions import confidence as C
from glyphmill.functions import distance as D
from glyphmill.functions import geometry as G
from glyphmill.functions import routing as R
from glyphmill.functions import text as X
from glyphmill.operators import decoding, documents, layout, lexicon, lines, manifest, metrics, recognizers, spans
from glyphmill.operators.arithmetic import arithmetic_results
from glyphmill.session import staged, table
from glyphmill.streaming import logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- pieces of oracle SQL ---------------------------------------------------------------------------------------------

S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # white space as Unicode has it


def q(text: str) -> str:
    return text.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def clean_sql(x: str) -> str:
    swaps = {c: d for c, d in (A.DIGITS_FOR | A.OPERATORS_FOR).items() if c not in A.NOISE}
    x = f"regexp_replace({x}, '({q('|'.join(A.MARKUP))})', ' ', 'gi')"
    x = f"translate({x}, '{A.NOISE}', '{' ' * len(A.NOISE)}')"
    x = f"translate({x}, '{''.join(swaps)}', '{''.join(swaps.values())}')"
    x = strip_sql(f"regexp_replace({x}, '{S}+', ' ', 'g')")
    x = rf"regexp_replace({x}, '[^\p{{Nd}}+\-*/=.\s]', '', 'g')"
    return strip_sql(rf"regexp_replace({x}, '([+\-*/=])\s*([+\-*/=])', '\1', 'g')")


def count_sql(x: str, what: str) -> str:
    return f"((length({x}) - length(replace({x}, '{what}', ''))) // {len(what)})"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"


#: Rows that a task gets, where it sorts them or keeps whole groups in memory.
TASK_ROWS = 250_000


def spread(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """df by the key in all shuffle partitions: the exchange that the next step needs anyway, in as many tasks as its work per row (not its few bytes) asks for.

    In more of them, where these would get more than TASK_ROWS of the table's rows each: a task's memory then doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), key)


def bounded(df: DataFrame, key: str) -> DataFrame:
    """A table (its rows are counted: of Parquet, in the footers) by the key as spread does; as it is where the session's own partitions are enough."""
    rows = df.count()
    return df if rows <= TASK_ROWS else spread(df, key, rows)


# --- inputs -----------------------------------------------------------------------------------------------------------


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): the quantities of each order as a sum."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("n")))).alias("a"))
    return rows.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("a", lambda r: r["n"].cast("string")), " + ").alias("raw"))


ORDER_TEXTS = "SELECT l_orderkey AS id, string_agg(CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR), ' + ' ORDER BY l_linenumber, CAST(trunc(l_quantity) AS INT)) AS raw FROM lineitem GROUP BY 1"


def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): sums, totals, means and quotients of an order's quantities, true for most orders and wrong for each seventh."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("n")))).alias("a"), F.sum(F.col("l_quantity").cast("int")).alias("s"), F.count(F.lit(1)).alias("c"))
    joined = F.array_join(F.transform("a", lambda r: r["n"].cast("string")), " + ")
    said = F.col("s") + F.when(F.col("l_orderkey") % 7 == 0, F.col("s") + 5).otherwise(0)
    kind = F.col("l_orderkey") % 4
    text = F.when(kind == 0, F.concat(joined, F.lit(" = "), said)).when(kind == 1, F.concat(F.replace(joined, F.lit(" + "), F.lit(" ")), F.lit(" total: "), said)).when(kind == 2, F.concat(F.replace(joined, F.lit(" + "), F.lit(" ")), F.lit(" mean = "), F.floor(said / F.col("c")))).otherwise(F.concat(said, F.lit(" / "), F.col("c"), F.lit(" = "), F.floor(F.col("s") / F.col("c"))))
    return rows.select(F.col("l_orderkey").alias("id"), text.alias("text"))


EQUATIONS = """SELECT id, CASE k WHEN 0 THEN j || ' = ' || said WHEN 1 THEN replace(j, ' + ', ' ') || ' total: ' || said WHEN 2 THEN replace(j, ' + ', ' ') || ' mean = ' || (said // c) ELSE said || ' / ' || c || ' = ' || (s // c) END AS text
FROM (SELECT *, s + CASE WHEN id % 7 = 0 THEN s + 5 ELSE 0 END AS said FROM (SELECT l_orderkey AS id, l_orderkey % 4 AS k, string_agg(CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR), ' + ' ORDER BY l_linenumber, CAST(trunc(l_quantity) AS INT)) AS j, CAST(sum(CAST(trunc(l_quantity) AS INT)) AS BIGINT) AS s, count(*) AS c FROM lineitem GROUP BY l_orderkey))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prediction, reference): each turn and the next one."""
    rows = spread(table(spark, sf_dir, "conversations").filter("text is not null"), "conv_id")
    return rows.withColumn("reference", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))).filter("reference is not null").select("conv_id", "turn", F.col("text").alias("prediction"), "reference")


# DuckDB's distance counts bytes: the accented letters of the tables become control characters, so that a letter is a byte there
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
BYTES = "".join(f" || chr({i})" for i in [*range(1, 9), *range(14, 27)])[4:]
PAIRS = f"SELECT conv_id, turn, translate(prediction, '{ACCENTED}', {BYTES}) AS prediction, translate(reference, '{ACCENTED}', {BYTES}) AS reference FROM (SELECT conv_id, turn, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS reference FROM conversations WHERE text IS NOT NULL) WHERE reference IS NOT NULL"
CER = "CASE WHEN length(reference) = 0 THEN CASE WHEN length(prediction) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(prediction, reference) / length(reference) END"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, corners, class_id, confidence): a box for each line item."""
    i = F.col("l_linenumber")
    x, y = F.floor(F.col("l_quantity") * 10).cast("int"), (F.floor("l_extendedprice") % 800).cast("int")
    rows = bounded(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("page_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), x.alias("x1"), y.alias("y1"), (x + 40 + i * 5).alias("x2"), (y + 15 + i).alias("y2"), (F.col("l_partkey") % 2).cast("int").alias("class_id"), F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"), F.concat(F.lit("w"), F.col("l_partkey")).alias("text"))


BOXES = """SELECT page_id, pos, x1, y1, x1 + 40 + i * 5 AS x2, y1 + 15 + i AS y2, class_id, confidence, text FROM (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
CAST(floor(l_quantity * 10) AS INT) AS x1, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 800 AS INT) AS y1, l_linenumber AS i, CAST(l_partkey % 2 AS INT) AS class_id, round(1 - l_discount * 5, 4) AS confidence, 'w' || l_partkey AS text FROM lineitem)"""

# --- arithmetic -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, c AS cleaned, len(regexp_extract_all(c, '{A.TOKEN}', 1)) AS n_tokens FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)")
def arith_clean_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", A.clean(F.col("text")).alias("cleaned"))
    return c.select("doc_id", "cleaned", F.size(A.tokens(F.col("cleaned"))).alias("n_tokens"))


@query(
    f"""WITH t AS ({ORDER_TEXTS}), k AS (SELECT id, raw, list_transform(list_filter(regexp_extract_all({clean_sql('raw')}, '{A.TOKEN}', 1), lambda x: regexp_matches(x, '^[0-9]')), lambda x: CAST(trunc(CAST(x AS DOUBLE)) AS INT)) AS nums, len(regexp_extract_all({clean_sql('raw')}, '{A.TOKEN}', 1)) AS n FROM t),
m0 AS (SELECT *, len(nums) AS c, list_sum(nums)::DOUBLE / len(nums) AS mean FROM k), m AS (SELECT *, sqrt(list_sum(list_transform(nums, lambda x: (x - mean) * (x - mean))) / c) AS sd FROM m0)
SELECT id, CASE WHEN c >= 2 THEN '(' || array_to_string(nums, ' + ') || ') / ' || c ELSE '' END AS expression, CASE WHEN c >= 2 THEN round(mean, 4) END AS result,
CASE WHEN c >= 2 THEN round(0.3::DOUBLE + (0.6::DOUBLE + 0.4::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - sd / 50::DOUBLE)) * 0.3::DOUBLE + 0.25::DOUBLE + CASE WHEN c >= 3 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * 0.15::DOUBLE, 4) ELSE 0.0 END AS confidence, CASE WHEN c >= 2 THEN 'success' ELSE 'retry' END AS status FROM m"""
)
def arith_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arithmetic_results(order_texts(spark, sf_dir))
    return out.select("id", "expression", "result", "confidence", "status")


@query(
    """WITH t AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS token FROM orders), v AS (SELECT CAST(n AS VARCHAR) AS n, n AS i FROM range(0, 101) r(n)),
s AS (SELECT token, i, levenshtein(token, n) AS d, 1.0::DOUBLE - levenshtein(token, n)::DOUBLE / greatest(length(token), length(n)) AS sim FROM t, v), b AS (SELECT token, first(i ORDER BY sim DESC, d, i) AS i, max(sim) AS sim FROM s GROUP BY 1)
SELECT token, CASE WHEN CAST(token AS BIGINT) <= 100 THEN CAST(token AS INT) WHEN sim >= 0.5 THEN CAST(i AS INT) END AS number, CASE WHEN CAST(token AS BIGINT) <= 100 THEN 1.0 WHEN sim >= 0.5 THEN round(sim, 6) END AS confidence FROM b"""
)
def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("token")), "token").distinct()
    return t.withColumn("c", A.correct_number(F.col("token"))).select("token", F.col("c.corrected").cast("int").alias("number"), F.round("c.confidence", 6).alias("confidence"))


@query(
    """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[+*/=:x<>|-]{1,2}', 0)) AS token FROM documents)
SELECT token, CASE WHEN token IN ('+', '-', '/', '=') THEN token WHEN token IN ('x', '*') THEN '+' WHEN token = ':' THEN '/' WHEN length(token) = 2 THEN CASE WHEN contains(token, '+') THEN '+' WHEN contains(token, '-') THEN '-' WHEN contains(token, '/') THEN '/' WHEN contains(token, '=') THEN '=' END END AS operator FROM t"""
)
def nearest_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([+*/=:x<>|-]{1,2})"), 1)).alias("token")).distinct()
    return t.withColumn("c", A.correct_operator(F.col("token"))).select("token", F.col("c.corrected").alias("operator"))


@query(f"SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '({q('|'.join(A.MARKUP))})', 1, 'i'), list_transform(list_filter(list_distinct(string_split(text, '')), lambda c: c <> '' AND contains('{A.NOISE}', c)), lambda c: 'structural:' || c)))) AS found FROM documents")
def hallucination_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.markup_found(F.col("text")).alias("found"))


@query("SELECT doc_id, len(list_filter([" + ", ".join(f"regexp_matches(text, '{p}')" for p, _ in A.BANNED) + "], lambda b: b)) AS n_banned FROM documents")
def hallucination_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(A.banned(F.col("text"))).alias("n_banned"))


# --- metrics ----------------------------------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, round({CER}, 6) AS cer, {strip_sql('prediction')} = {strip_sql('reference')} AS exact FROM ({PAIRS})")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("prediction"), F.col("reference")
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(D.cer(p, r), 6).alias("cer"), (D.stripped(p) == D.stripped(r)).alias("exact"))


@query(f"SELECT round(avg(c), 6) AS mean_cer, round(list_sort(list(c))[count(*) // 2 + 1], 6) AS median_cer, round(avg(CAST(e AS INT)), 6) AS exact_rate, count(*) AS n FROM (SELECT {CER} AS c, {strip_sql('prediction')} = {strip_sql('reference')} AS e FROM ({PAIRS}))")
def cer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("prediction"), F.col("reference")
    rated = pairs(spark, sf_dir).select(D.cer(p, r).alias("cer"), (D.stripped(p) == D.stripped(r)).alias("exact"))
    rated = staged(rated, "rates")
    middle = metrics.upper_median(rated, [], "cer")
    means = rated.agg(F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"), F.count(F.lit(1)).alias("n"))
    return means.crossJoin(middle.agg(F.round(F.min("median"), 6).alias("median_cer"))).select("mean_cer", "median_cer", "exact_rate", "n")


@query(f"SELECT CASE WHEN c < 0.05 THEN 'excellent' WHEN c < 0.15 THEN 'good' WHEN c < 0.3 THEN 'moderate' ELSE 'poor' END AS band, count(*) AS n, round(avg(greatest(0, 1 - c)), 6) AS accuracy FROM (SELECT {CER} AS c FROM ({PAIRS})) GROUP BY 1")
def cer_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pairs(spark, sf_dir).select(D.cer(F.col("prediction"), F.col("reference")).alias("cer"))
    return rated.groupBy(D.quality_band(F.col("cer")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(D.accuracy(F.col("cer"))), 6).alias("accuracy"))


def sequence_sql(source: str) -> str:
    """Statements that end with `edits`: (conv_id, turn, v, n_p, n_r) of rows (conv_id, turn, p list, r list), by the table of distances, a row of it for each step."""
    return f"""s AS (SELECT row_number() OVER () AS id, * FROM ({source})), p AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM s), r AS (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM s),
d AS (SELECT id, 0 AS i, unnest(range(0, len(r) + 1)) AS j, unnest(range(0, len(r) + 1)) AS v FROM s UNION ALL SELECT id, i, j, min(t - j) OVER (PARTITION BY id ORDER BY j) + j FROM
(SELECT d.id, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + CASE WHEN p.w = r.w THEN 0 ELSE 1 END) END AS t FROM d JOIN p ON p.id = d.id AND p.i = d.i + 1 LEFT JOIN r ON r.id = d.id AND r.j = d.j)),
edits AS (SELECT s.conv_id, s.turn, s.prediction, s.reference, v, len(p) AS n_p, len(r) AS n_r FROM s JOIN d ON s.id = d.id AND d.i = len(s.p) AND d.j = len(s.r))"""


WER = "CASE WHEN n_r = 0 THEN CASE WHEN n_p = 0 THEN 0.0 ELSE 1.0 END ELSE v / n_r END"


@query(
    f"WITH RECURSIVE {sequence_sql(f'SELECT *, ' + words_sql('prediction') + ' AS p, ' + words_sql('reference') + f' AS r FROM ({PAIRS})')} SELECT conv_id, turn, round(CASE WHEN length(reference) = 0 THEN CASE WHEN length(prediction) = 0 THEN 0.0 ELSE 1.0 END ELSE {WER} END, 6) AS wer, round({WER}, 6) AS wer_stripped FROM edits"
)
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("prediction"), F.col("reference")
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(D.wer(p, r), 6).alias("wer"), F.round(D.wer_stripped(p, r), 6).alias("wer_stripped"))


FORMULAS = [r"\frac{a}{b} + c", r"\sqrt {x", r"\sum _{i} \int _0", "$x^2$", r"\ldots 5 \times 70.5", "(2+33", r"\alpha  { y }"]
#: Their tokens of several characters.
LONG_TOKENS = [r"\frac", r"\sqrt", r"\sum", r"\int", r"\ldots", r"\times", "70.5", "33", r"\alpha"]
FORMULAS_SQL, LONG_SQL = ("['" + "', '".join(map(q, x)) + "']" for x in (FORMULAS, LONG_TOKENS))
TOKENS_SQL = lambda x: rf"list_transform(regexp_extract_all(regexp_replace({strip_sql(x)}, '^\$+|\$+$', '', 'g'), '(?s)(\\\p{{L}}+|\\.?|\p{{Nd}}[\p{{Nd}}.]*|[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}])', 1), lambda t: CASE WHEN length(t) > 1 THEN chr(CAST(64 + list_position({LONG_SQL}, t) AS INT)) ELSE t END)"
FORMULA_PAIRS = f"SELECT conv_id, turn, {FORMULAS_SQL}[(conv_id + turn) % {len(FORMULAS)} + 1] || ' ' || regexp_replace(prediction, '[A-I0-9]', '', 'g') AS prediction, {FORMULAS_SQL}[conv_id % {len(FORMULAS)} + 1] || ' ' || regexp_replace(reference, '[A-I0-9]', '', 'g') AS reference FROM ({PAIRS})"


def formula_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that start with formulas (without digits and the first capital letters, which stand for the long tokens in the oracle)."""
    said = F.array(*[F.lit(x) for x in FORMULAS])
    put = lambda n, text: F.concat(F.element_at(said, (n % len(FORMULAS) + 1).cast("int")), F.lit(" "), F.regexp_replace(text, "[A-I0-9]", ""))
    return pairs(spark, sf_dir).select("conv_id", "turn", put(F.col("conv_id") + F.col("turn"), "prediction").alias("prediction"), put(F.col("conv_id"), "reference").alias("reference"))


TOKEN_EDITS = f"SELECT *, levenshtein(array_to_string(p, ''), array_to_string(r, '')) AS v, len(p) AS n_p, len(r) AS n_r FROM (SELECT *, {TOKENS_SQL('prediction')} AS p, {TOKENS_SQL('reference')} AS r FROM ({FORMULA_PAIRS}))"


@query(f"SELECT conv_id, turn, v AS edits, n_r AS n_reference FROM ({TOKEN_EDITS})")
def token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = D.latex_tokens(F.col("prediction")), D.latex_tokens(F.col("reference"))
    rows = formula_pairs(spark, sf_dir).select("conv_id", "turn", p.alias("p"), r.alias("r"))
    return rows.select("conv_id", "turn", D.sequence_distance(F.col("p"), F.col("r")).alias("edits"), F.size("r").alias("n_reference"))


@query(rf"SELECT doc_id, len(regexp_extract_all(regexp_replace({strip_sql('text')}, '^\$+|\$+$', '', 'g'), '(?s)(\\\p{{L}}+|\\.?|\p{{Nd}}[\p{{Nd}}.]*|[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}])', 1)) AS n_tokens FROM documents")
def latex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(D.latex_tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT conv_id, turn, regexp_replace(prediction, '{S}+', '', 'g') = regexp_replace(reference, '{S}+', '', 'g') AS exact FROM ({PAIRS})")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", D.exact_expression(F.col("prediction"), F.col("reference")).alias("exact"))


@query(
    f"SELECT round(avg({WER}), 6) AS mean_distance, round(list_sort(list({WER}))[count(*) // 2 + 1], 6) AS median_distance, CAST(sum(v) AS BIGINT) AS edits, CAST(sum(n_r) AS BIGINT) AS tokens, round(1 - sum(v) / sum(n_r), 6) AS micro_accuracy, round(avg(CAST(regexp_replace(prediction, '{S}+', '', 'g') = regexp_replace(reference, '{S}+', '', 'g') AS INT)), 6) AS exact_rate, count(*) AS n FROM ({TOKEN_EDITS})"
)
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.math_summary(formula_pairs(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


LOWER = "abcdefghijklmnopqrstuvwxyz"


def engine_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    preds = F.create_map(F.lit("upper"), F.translate("reference", LOWER, LOWER.upper()), F.lit("trimmed"), F.substring(F.col("reference"), 2, 1 << 30), F.lit("neighbour"), F.col("prediction"))
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "reference", preds.alias("predictions"))


ENGINES = f"""SELECT engine, prediction, reference FROM (SELECT 'upper' AS engine, translate(reference, '{LOWER}', '{LOWER.upper()}') AS prediction, reference FROM p UNION ALL SELECT 'trimmed', substr(reference, 2), reference FROM p UNION ALL SELECT 'neighbour', prediction, reference FROM p)"""


@query(f"WITH p AS ({PAIRS}) SELECT engine, round(avg({CER}), 6) AS mean_cer, round(avg(CAST({strip_sql('prediction')} = {strip_sql('reference')} AS INT)), 6) AS exact_rate, count(*) AS n FROM ({ENGINES}) GROUP BY 1")
def engine_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.compare_engines(engine_samples(spark, sf_dir))
    return out.select("engine", F.round("mean_cer", 6).alias("mean_cer"), F.round("exact_rate", 6).alias("exact_rate"), "n")


@query(f"WITH p AS ({PAIRS}) SELECT engine, round(m, 6) AS mean_cer FROM (SELECT engine, avg({CER}) AS m FROM ({ENGINES}) GROUP BY 1) ORDER BY m, engine LIMIT 1")
def best_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(metrics.compare_engines(engine_samples(spark, sf_dir)), "engine", "mean_cer").select("engine", F.round("mean_cer", 6).alias("mean_cer"))


@query(f"WITH p AS ({PAIRS}), m AS (SELECT engine, avg({CER}) AS c, avg(CAST({strip_sql('prediction')} = {strip_sql('reference')} AS INT)) AS e, count(*) AS n FROM ({ENGINES}) GROUP BY 1) SELECT '| engine | CER | exact | n |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg(format('| {{}} | {{:.4f}} | {{:.4f}} | {{}} |', engine, c, e, n), chr(10) ORDER BY c, engine) AS report FROM m")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(metrics.compare_engines(engine_samples(spark, sf_dir)), ("mean_cer", "exact_rate"))


# --- confidence -------------------------------------------------------------------------------------------------------

ALPHA = rf"CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,;:!?\-+=/()\[\]{{}}$\\]', '', 'g')) / length(text) END"
LENGTH = f"CASE WHEN length({strip_sql('text')}) < 2 THEN greatest(0.1, length({strip_sql('text')}) / 2 * 0.4) WHEN length({strip_sql('text')}) <= 500 THEN 1.0 ELSE 0.4 END"


@query(f"SELECT doc_id, round({ALPHA}, 6) AS alpha_ratio, round({LENGTH}, 6) AS length_score FROM documents")
def alpha_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.alpha_ratio(F.col("text")), 6).alias("alpha_ratio"), F.round(C.length_score(F.col("text")), 6).alias("length_score"))


def scored(df: DataFrame) -> DataFrame:
    df = df.withColumn("check", C.math_check(F.col("text")))
    df = df.withColumn("composite", C.composite(F.col("text"), F.lit(0.5), F.col("check")))
    return df.withColumn("tag", C.classify(F.col("composite")))


NUM = r"(-?\p{Nd}+\.?\p{Nd}*)"


def check_sql(source: str) -> str:
    """id, text, boost, is_math, validated of the lines of a source (id, text)."""
    nums = lambda x: f"list_transform(regexp_extract_all({x}, '{NUM}', 1), lambda v: CAST(v AS DOUBLE))"
    grab = lambda p, g=1, flag="": f"TRY_CAST(nullif(regexp_extract(text, '{p}', {g}{flag}), '') AS DOUBLE)"
    near = lambda a, b, least, share: f"abs({a} - {b}) <= greatest({least}, abs({a}) * {share})"
    div = r"(\p{Nd}+\.?\p{Nd}*)\s*/\s*(\p{Nd}+\.?\p{Nd}*)\s*=\s*(\p{Nd}+\.?\p{Nd}*)"
    i = ", 'i'"
    return rf"""(SELECT id, text, greatest(-0.15, least(0.15, b)) AS boost, is_math, b > 0 AS validated FROM (SELECT *, CASE WHEN is_math THEN
CASE WHEN res IS NOT NULL AND len(adds) > 0 THEN CASE WHEN {near('list_sum(adds)', 'res', 1.0, 0.05)} THEN 0.12::DOUBLE ELSE -0.05::DOUBLE END ELSE 0.0::DOUBLE END
+ CASE WHEN said IS NOT NULL AND len(rest) > 0 THEN CASE WHEN {near('list_sum(rest)', 'said', 1.0, 0.05)} THEN 0.10::DOUBLE ELSE -0.05::DOUBLE END ELSE 0.0::DOUBLE END
+ CASE WHEN mid IS NOT NULL AND len(others) > 0 THEN CASE WHEN {near('list_avg(others)', 'mid', 0.5, 0.05)} THEN 0.10::DOUBLE ELSE -0.05::DOUBLE END ELSE 0.0::DOUBLE END
+ CASE WHEN db <> 0 AND {near('(da / db)', 'dc', 0.01, 0.02)} THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS b FROM (SELECT *, list_filter(nums, lambda v: v <> said) AS rest, list_filter(nums, lambda v: v <> mid) AS others FROM (SELECT id, text, {nums('text')} AS nums,
len(regexp_extract_all(text, '{NUM}', 1)) >= 2 AND (regexp_matches(text, '[+\-*/=]') OR regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])(sum|total|mean|average|avg|result|answer)($|[^\p{{L}}\p{{N}}_])', 'i')) AS is_math,
CASE WHEN contains(text, '+') THEN {grab(r'=\s*(-?\p{Nd}+\.?\p{Nd}*)\s*$')} END AS res, {nums("regexp_replace(text, '=[^=]*$', '')")} AS adds, {grab(r'(?:sum|total)\s*[=:]\s*' + NUM, 1, i)} AS said, {grab(r'(?:mean|average|avg)\s*[=:]\s*' + NUM, 1, i)} AS mid,
{grab(div, 1)} AS da, {grab(div, 2)} AS db, {grab(div, 3)} AS dc FROM ({source})))))"""


def composite_sql(source: str) -> str:
    return f"(SELECT *, CASE WHEN composite >= 0.85 THEN 'ACCEPTED' WHEN composite >= 0.65 THEN 'RETRY_REQUIRED' ELSE 'FAILED_EXTRACTION' END AS tag FROM (SELECT id, text, boost, validated, round(greatest(0, least(1, 0.45 * 0.5 + 0.25 * ({ALPHA}) + 0.15 * ({LENGTH}) + 0.15 * CASE WHEN validated THEN 1.0 WHEN is_math THEN 0.3 ELSE 0.5 END + boost)), 4) AS composite FROM {check_sql(source)}))"


@query(f"SELECT id, text, round(boost, 4) AS boost, is_math, validated FROM {check_sql(EQUATIONS)}")
def math_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = equations(spark, sf_dir).withColumn("check", C.math_check(F.col("text")))
    return e.select("id", "text", F.round("check.boost", 4).alias("boost"), "check.is_math", "check.validated")


@query(f"SELECT id, round(composite, 3) AS composite FROM {composite_sql(EQUATIONS)}")
def composite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(equations(spark, sf_dir)).select("id", F.round("composite", 3).alias("composite"))


@query(f"SELECT tag, count(*) AS n, round(avg(composite), 4) AS mean_composite FROM {composite_sql('SELECT doc_id AS id, text FROM documents')} GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("composite"), 4).alias("mean_composite"))


@query(f"SELECT page, count_if(tag = 'ACCEPTED') AS accepted, count_if(tag = 'RETRY_REQUIRED') AS retry, count_if(tag = 'FAILED_EXTRACTION') AS failed, round(coalesce(avg(composite) FILTER (tag <> 'FAILED_EXTRACTION'), 0.0), 4) AS overall FROM (SELECT id // 100 AS page, * FROM {composite_sql(EQUATIONS)}) GROUP BY 1")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(equations(spark, sf_dir)).select(F.expr("id div 100").alias("page"), "tag", F.col("composite").alias("confidence"))
    return metrics.page_summary(rows, "page")


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{NUM}', 1)) AS n_numbers, list_max(list_transform(regexp_extract_all(text, '{NUM}', 1), lambda v: CAST(v AS DOUBLE))) AS largest FROM documents")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", C.numbers(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("n_numbers"), F.array_max("v").alias("largest"))


@query(r"SELECT id, CAST(regexp_matches(text, '[+\-*/=]') AS INT) + CAST(regexp_matches(text, '\b[0-9]+\b.*\b[0-9]+\b') AS INT) + CAST(regexp_matches(text, '\b(sum|mean|total|avg)\b', 'i') AS INT) >= 2 AS is_math FROM (" + EQUATIONS + ")")
def is_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equations(spark, sf_dir).select("id", C.is_math(F.col("text")).alias("is_math"))


FUSED = f"""WITH l AS (SELECT id, text AS a, composite AS sa, validated AS va, CASE WHEN id % 3 = 0 THEN upper(text) || ' ' ELSE text || ' x' END AS b, round(composite - 0.02, 4) AS sb, id % 5 = 0 AS vb FROM {composite_sql(EQUATIONS)}),
g AS (SELECT *, lower(regexp_replace({strip_sql('a')}, '{S}+', ' ', 'g')) = lower(regexp_replace({strip_sql('b')}, '{S}+', ' ', 'g')) AS agreed, sa + CASE WHEN va THEN 0.05 ELSE 0 END >= sb + CASE WHEN vb THEN 0.05 ELSE 0 END AS best FROM l),
h AS (SELECT *, CASE WHEN agreed THEN best WHEN va AND NOT vb THEN true WHEN vb AND NOT va THEN false ELSE best END AS f FROM g) SELECT id, CASE WHEN f THEN a ELSE b END AS text, agreed, round(CASE WHEN agreed THEN least(1.0, CASE WHEN f THEN sa ELSE sb END + 0.1) ELSE CASE WHEN f THEN sa ELSE sb END END, 3) AS composite FROM h"""


@query(FUSED)
def fuse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = scored(equations(spark, sf_dir)).select("id", "text", "composite", F.col("check.validated").alias("valid"))
    b = F.when(F.col("id") % 3 == 0, F.concat(F.upper("text"), F.lit(" "))).otherwise(F.concat("text", F.lit(" x")))
    fused = C.fuse(F.col("text"), F.col("composite"), F.col("valid"), b, F.round(F.col("composite") - 0.02, 4), F.col("id") % 5 == 0)
    return a.withColumn("f", fused).select("id", "f.text", "f.agreed", F.round("f.composite", 3).alias("composite"))


@query(f"SELECT id FROM {composite_sql('SELECT doc_id AS id, text FROM documents')} WHERE tag = 'RETRY_REQUIRED'")
def retry_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.filter(C.should_retry(F.col("tag"))).select("id")


EXP = "list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))"


@query(f"SELECT vec_id, round(1 / list_sum({EXP}), 6) AS token_confidence, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.token_confidence(steps), 6).alias("token_confidence"), C.greedy(steps, -1)[0].cast("bigint").alias("best"))


P = "list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))"


@query(f"SELECT vec_id, round(0.4 * list_avg(p) + 0.3 * list_min(p) + 0.3 / (1 - list_avg(list_transform(p, lambda x: x * ln(x + 1e-10)))), 5) AS sequence_confidence, round(exp(list_avg(list_transform(p, lambda x: ln(x + 1e-10)))), 5) AS geometric FROM (SELECT vec_id, {P} AS p FROM embeddings)")
def seq_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"))
    return rows.select("vec_id", F.round(C.sequence_confidence(F.col("p")), 5).alias("sequence_confidence"), F.round(C.geometric_confidence(F.col("p")), 5).alias("geometric"))


# --- routing ----------------------------------------------------------------------------------------------------------

ROUTE_FEATURES = "SELECT event_id, CAST(event_id % 160 AS DOUBLE) AS blur, CAST(event_id * 7 % 90 AS DOUBLE) AS contrast, (event_id * 13 % 100) / 200.0 AS math, (event_id * 11 % 100) / 300.0 AS density, CAST(event_id % 9 AS INT) AS n_lines FROM events"


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (e % 160).cast("double").alias("blur"), (e * 7 % 90).cast("double").alias("contrast"), ((e * 13 % 100) / 200.0).alias("math"), ((e * 11 % 100) / 300.0).alias("density"), (e % 9).cast("int").alias("n_lines"))


@query(f"SELECT event_id, CASE WHEN blur < 80 OR contrast < 40 THEN 'degraded' ELSE 'clean' END AS profile, CASE WHEN contrast < 10 OR density < 0.005 THEN 'none' WHEN math > 0.3 THEN 'mathpix' WHEN n_lines <= 5 AND density < 0.15 THEN 'arithmetic' ELSE 'trocr' END AS engine, CASE WHEN n_lines <= 5 AND density < 0.15 THEN 'arithmetic' WHEN math > 0.3 THEN 'mathpix' WHEN math > 0.15 THEN 'both' ELSE 'trocr' END AS smart FROM ({ROUTE_FEATURES})")
def route_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = route_features(spark, sf_dir)
    every = F.array(*[F.lit(x) for x in ("mathpix", "arithmetic", "trocr")])
    arithmetic, blank = R.is_arithmetic(F.col("n_lines"), F.col("density")), R.is_blank(F.col("contrast"), F.col("density"))
    return f.select("event_id", R.profile(F.col("blur"), F.col("contrast")).alias("profile"), R.decide(F.col("math"), arithmetic, blank, every)["engine"].alias("engine"), R.smart_route(F.col("math"), arithmetic, every).alias("smart"))


@query("SELECT event_id, CASE kind WHEN 'text' THEN 'printed' WHEN 'equation' THEN 'formula' WHEN 'handwriting' THEN 'handwriting' END AS engine, CASE WHEN tc < 0.4 AND fc > tc AND NOT bad THEN 'f' ELSE 't' END AS chosen, CASE WHEN tc >= 0.85 THEN 'accepted' WHEN tc >= 0.65 THEN 'retry' ELSE 'failed' END AS badge FROM (SELECT event_id, ['text', 'equation', 'handwriting', 'odd'][event_id % 4 + 1] AS kind, (event_id % 10) / 10.0 AS tc, (event_id * 3 % 10) / 10.0 AS fc, event_id % 7 = 0 AS bad FROM events)")
def region_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "equation", "handwriting", "odd")]), (e % 4 + 1).cast("int"))
    rows = recognizers.route_regions(table(spark, sf_dir, "events").select("event_id", kind.alias("type"), ((e % 10) / 10.0).alias("tc"), ((e * 3 % 10) / 10.0).alias("fc"), (e % 7 == 0).alias("bad")))
    chosen = R.reroute(F.lit("t"), F.col("tc"), F.lit("f"), F.col("fc"), F.col("bad"), F.lit(False))
    return rows.select("event_id", "engine", chosen["text"].alias("chosen"), R.badge(C.classify(F.col("tc"))).alias("badge"))


@query("SELECT p_partkey, round(least(640 / h, 640 / w), 6) AS ratio, CAST(ceil(h / 32) * 32 AS INT) AS padded, CASE WHEN h < 100 THEN round(300 / 72, 6) WHEN h < 200 THEN 1.5 ELSE 1.0 END AS scale FROM (SELECT p_partkey, CAST(p_size * 20 + 1 AS INT) AS h, CAST(p_size * 7 + 3 AS INT) AS w FROM part)")
def image_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20 + 1).alias("h"), (F.col("p_size") * 7 + 3).alias("w"))
    return rows.select("p_partkey", F.round(G.letterbox(F.col("w"), F.col("h"))["ratio"], 6).alias("ratio"), G.stride_padded(F.col("h")).alias("padded"), F.round(G.resolution_scale(F.col("h")), 6).alias("scale"))


# --- text -------------------------------------------------------------------------------------------------------------

ARTIFACTS = strip_sql(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{S}*#{S}*', ' ', 'g'), '([.!?,;:]){{3,}}', '\\1', 'g'), '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}#*\\-_=]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}#*\\-_=]+$', ''), '{S}+', ' ', 'g')")


@query(f"SELECT doc_id, {ARTIFACTS} AS cleaned FROM documents")
def artifact_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.remove_artifacts(F.col("text")).alias("cleaned"))


LATEX = [r"\frac{a}{b} + c", r"\sqrt {x", r"a}b{c", r"\sum _{i} \int _0", "$x^2$", r"\begin{a} x \end{a}", r"\ldots 5 \times 7", "(2+3", "4)=x", r"\alpha  { y }", "Z + l = O", "??? q"]
LATEX_SQL = "(SELECT doc_id, ['" + "', '".join(q(x) for x in LATEX) + f"'][doc_id % {len(LATEX)} + 1] || CASE WHEN doc_id % 5 = 0 THEN ' }}' ELSE '' END AS latex FROM documents)"


def latex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.element_at(F.array(*[F.lit(x) for x in LATEX]), (d % len(LATEX) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.when(d % 5 == 0, " }").otherwise("")).alias("latex"))


def strip_markup_sql(x: str) -> str:
    for p in (r"\\frac\{[^}]*\}\{[^}]*\}", r"\\ldots", r"\\times", r"\\cdot", r"\\sqrt\{[^}]*\}", r"\\sum", r"\\int", r"\\[a-zA-Z]+", r"[{}]"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return strip_sql(f"regexp_replace({x}, '{S}+', ' ', 'g')")


@query(f"SELECT doc_id, {strip_markup_sql('latex')} AS stripped FROM {LATEX_SQL}")
def latex_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex_lines(spark, sf_dir).select("doc_id", X.strip_markup(F.col("latex")).alias("stripped"))


BALANCE = "list_reduce(list_prepend({'o': '', 'd': 0}, list_transform(string_split(latex, ''), lambda c: {'o': c, 'd': 0})), lambda s, c: CASE WHEN c.o = '{' THEN {'o': s.o || c.o, 'd': s.d + 1} WHEN c.o = '}' THEN CASE WHEN s.d > 0 THEN {'o': s.o || c.o, 'd': s.d - 1} ELSE s END ELSE {'o': s.o || c.o, 'd': s.d} END)"


@query(f"SELECT doc_id, b.o || repeat('}}', b.d) AS balanced FROM (SELECT doc_id, {BALANCE} AS b FROM {LATEX_SQL})")
def latex_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex_lines(spark, sf_dir).select("doc_id", X.balance_braces(F.col("latex")).alias("balanced"))


def tidy_sql(x: str) -> str:
    for pattern, after in ((rf"\\frac{S}+\{{", r"\frac{"), (rf"\\sqrt{S}+\{{", r"\sqrt{"), (rf"\\sum{S}+_", r"\sum_"), (rf"\\int{S}+_", r"\int_"), (rf"\\lim{S}+_", r"\lim_"), (rf"\\{S}+", "\\"), (rf"\{{{S}+", "{"), (rf"{S}+\}}", "}")):
        after = after.replace("\\", "\\\\")
        x = f"regexp_replace({x}, '{pattern}', '{after}', 'g')"
    return x


BARE = "CASE WHEN t LIKE '$%' AND t LIKE '%$' THEN CASE WHEN length(t) > 1 THEN substr(t, 2, length(t) - 2) ELSE '' END ELSE t END"
PLAIN_MATH = strip_sql("replace(replace(replace(replace(replace(replace(t, '$$', ''), '$', ''), '\\[', ''), '\\]', ''), '\\(', ''), '\\)', '')")
DEPTHS = "list_transform(range(1, length(latex) + 1), lambda i: length(replace(substr(latex, 1, i), '}', '')) - length(replace(substr(latex, 1, i), '{', '')))"
VALID = f"(t <> '' AND len(list_filter({DEPTHS}, lambda d: d < 0)) = 0 AND list_last({DEPTHS}) = 0 AND {count_sql('latex', chr(92) + 'begin')} = {count_sql('latex', chr(92) + 'end')})"
DISPLAY = r"regexp_matches(latex, '\\frac|\\sum|\\prod|\\int|\\lim|\\begin\{|\\matrix')"


@query(
    f"""SELECT doc_id, {tidy_sql("b.o || repeat('}', b.d)")} AS cleaned, regexp_replace(regexp_replace(repeat('{{', greatest(0, c - o)) || u || repeat('}}', greatest(0, o - c)), '\\\\frac{S}*\\{{', '\\\\frac{{', 'g'), '\\\\sqrt{S}*\\{{', '\\\\sqrt{{', 'g') AS postprocessed, valid, CASE WHEN NOT valid THEN 0.1::DOUBLE WHEN contains(latex, '???') OR contains(latex, '\\unknown') THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
CASE WHEN display THEN '$$' || chr(10) || m || chr(10) || '$$' ELSE '$' || m || '$' END AS formatted, looks FROM (SELECT *, {BALANCE.replace('latex', 't')} AS b, {count_sql('u', '{')} AS o, {count_sql('u', '}')} AS c, {VALID} AS valid, {DISPLAY} AS display, regexp_matches(latex, '[\\\\_^{{}}]') AND {count_sql('latex', '{')} = {count_sql('latex', '}')} AS looks FROM (SELECT *, {BARE} AS u, {PLAIN_MATH} AS m FROM (SELECT *, {strip_sql('latex')} AS t FROM {LATEX_SQL})))"""
)
def latex_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("latex")
    return latex_lines(spark, sf_dir).select("doc_id", X.cleanup_latex(c).alias("cleaned"), X.postprocess_latex(c).alias("postprocessed"), X.valid_latex(c).alias("valid"), X.latex_confidence(c).alias("confidence"), X.format_math(c, X.is_display_math(c)).alias("formatted"), X.looks_like_latex(c).alias("looks"))


NORMAL = f"translate(regexp_replace(latex, '{S}*([+\\-=]){S}*', ' \\1 ', 'g'), '×÷', '*/')"


@query(f"SELECT doc_id, repeat('(', greatest(0, c - o)) || n || repeat(')', greatest(0, o - c)) AS normalized FROM (SELECT doc_id, n, {count_sql('n', '(')} AS o, {count_sql('n', ')')} AS c FROM (SELECT doc_id, {NORMAL} AS n FROM {LATEX_SQL}))")
def normalize_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex_lines(spark, sf_dir).select("doc_id", X.normalize_math(F.col("latex")).alias("normalized"))


def symbols_sql(x: str) -> str:
    for wrong, right in X.SYMBOLS:
        for _ in range(2):  # neighbours share the character between them
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){wrong}($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1{right}\2', 'g')"
    return x


@query(f"SELECT doc_id, {symbols_sql('text')} AS corrected FROM documents")
def symbol_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.symbol_rules(F.col("text")).alias("corrected"))


def typos_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '{S}{{2,}}', ' ', 'g')"
    for wrong, right in X.TYPOS:
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){wrong}($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1{right}\2', 'gi')"
    return rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])form({S}+the)', '\1from\2', 'gi')"


@query(f"SELECT conv_id, turn, {typos_sql('text')} AS corrected FROM conversations WHERE text IS NOT NULL")
def grammar_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", X.fix_typos(F.col("text")).alias("corrected"))


@query(
    f"""WITH l AS (SELECT conv_id, turn, {strip_sql('text')} AS text FROM conversations WHERE {strip_sql("coalesce(text, '')")} <> ''), e AS (SELECT *, coalesce(CAST(regexp_matches(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), '[.!?:;]$') AS INT), 0) AS ended FROM l),
i AS (SELECT *, sum(ended) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS island FROM e) SELECT conv_id, CAST(island AS BIGINT) AS island, string_agg(text, ' ' ORDER BY turn, text) AS text FROM i GROUP BY 1, 2"""
)
def merge_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_broken(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0 OR len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0 AS repeated FROM (SELECT doc_id, {words_sql('lower(text)')} AS w, string_split(text, '') AS c FROM documents)")
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.has_repetition(F.col("text")).alias("repeated"))


@query(f"WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM w) SELECT doc_id, count(*) AS n_words, CAST(sum(o) AS BIGINT) AS offsets FROM (SELECT doc_id, place, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p) GROUP BY 1")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.word_offsets(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("offset").alias("offsets"))


REPEATED = f"(len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0 OR len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0)"


@query(
    f"""WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(replace(text, ' ', '')), 0) AS ratio, {words_sql('lower(text)')} AS w, string_split(text, '') AS c FROM documents), j AS (SELECT *, CASE WHEN {strip_sql('text')} = '' THEN 'empty_text' WHEN ratio IS NULL THEN 'no_characters' WHEN ratio < 0.7 THEN 'low_alpha_ratio' WHEN {REPEATED} THEN 'excessive_repetition' ELSE 'passed' END AS reason FROM t)
SELECT doc_id, reason = 'passed' AS plausible, round(CASE reason WHEN 'empty_text' THEN 0.0 WHEN 'no_characters' THEN 0.0 WHEN 'low_alpha_ratio' THEN ratio WHEN 'excessive_repetition' THEN 0.3 ELSE least(1.0, ratio * 1.2) END, 6) AS confidence, reason FROM j"""
)
def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.plausibility(F.col("text")).alias("p"))
    return rows.select("doc_id", "p.plausible", F.round("p.confidence", 6).alias("confidence"), "p.reason")


@query(f"SELECT doc_id, CASE WHEN (doc_id % 10) / 10.0 < 0.5 THEN 'confidence_below_threshold' WHEN {strip_sql('text')} = '' THEN 'empty_output' WHEN len(list_distinct(string_split(text, ''))) < 3 AND length(text) > 5 THEN 'low_character_diversity' END AS reason FROM documents")
def reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.rejection((F.col("doc_id") % 10) / 10.0, F.col("text")).alias("reason"))


@query(r"SELECT count(*) AS n, count_if(contains(d.text, '0') AND NOT regexp_matches(b.text, '\p{Nd}')) AS zeros, round(100.0 * count_if(contains(d.text, '0') AND NOT regexp_matches(b.text, '\p{Nd}')) / count(*), 4) AS zero_rate, count_if(contains(lower(d.text), 'catalog') AND contains(lower(b.text), 'catalyze')) AS drifts FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id")
def zero_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    items = b.agg(F.max("item_id") + 1).first()[0]
    both = d.join(b, F.col("doc_id") % items == F.col("item_id"))
    bad = X.zero_hallucinated(F.col("text"), F.col("truth"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("zeros"), F.round(100.0 * F.count_if(bad) / F.count(F.lit(1)), 4).alias("zero_rate"), F.count_if(F.lower("text").contains("catalog") & F.lower("truth").contains("catalyze")).alias("drifts"))


@query("SELECT doc_id, len(list_filter([contains(text, '0'), contains(lower(text), 'catalog'), contains(text, '..')], lambda b: b)) AS n_issues FROM documents")
def forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.forbidden(F.col("text"))).alias("n_issues"))


SLIPS = ["I saw  the end.next one", "teh cat and hte dog", "All is well.", "i think. so it is", "two   blanks nad more", "He said: I  am"]
SLIPS_SQL = "['" + "', '".join(SLIPS) + "']"
AT = "regexp_matches(substr(text, i), '^{}')"
BOUND = "(i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]'))"


def slips_sql() -> str:
    """(event_id, offset, length, kind): places at which a pattern starts, tried at every character."""
    parts = []
    for pattern, kind, before in ((r"([Ii])\s+([a-z])", "Missing uppercase after ''I''", BOUND), (r"\s{2,}", "Multiple spaces", "(i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '\\s'))"), (r"(\w)\.\s*([a-z])", "Missing uppercase after period", "true"), (r"(teh|hte|adn|nad)\b", "Common misspelling", BOUND)):
        found = f"regexp_extract(substr(text, i), '^{pattern}')"
        parts.append(f"SELECT event_id, CAST(i - 1 AS INT) AS \"offset\", CAST(length({found}) AS INT) AS length, '{kind}' AS kind FROM t WHERE {found} <> '' AND {before}")
    return " UNION ALL ".join(parts)


@query(f"WITH t AS (SELECT event_id, text, unnest(range(1, length(text) + 1)) AS i FROM (SELECT event_id, {SLIPS_SQL}[event_id % {len(SLIPS)} + 1] || ' ' || event_type AS text FROM events)) {slips_sql()}")
def grammar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in SLIPS]), (F.col("event_id") % len(SLIPS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(said, F.lit(" "), "event_type").alias("text"))
    return spans.spans(rows, "event_id", spans.grammar_errors).drop("context")


# --- lexicon ----------------------------------------------------------------------------------------------------------


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lexicon(table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z]{3,})\b"), 1)).alias("word")))


LEX = r"(SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}\p{Pc}]+)', 1), lambda w: regexp_matches(w, '^[a-z]{3,}$'))) AS word FROM benchmark)"
# whole words: letters that nothing of a word stands beside
DOC_WORDS = r"(SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}\p{Pc}]+)', 1), lambda w: regexp_matches(w, '^[a-z]+$'))) AS word FROM documents)"


@query(f"WITH lex AS {LEX}, w AS {DOC_WORDS}, c AS (SELECT doc_id, count(*) AS total, count(lex.word) AS known FROM w LEFT JOIN lex USING (word) GROUP BY 1) SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(known, 0) AS in_vocab, round(CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE greatest(0, least(1, known / total * 0.3 + 0.7 - (1 - known / total) * 0.1)) END, 6) AS score FROM documents d LEFT JOIN c USING (doc_id)")
def lexicon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.coverage(table(spark, sf_dir, "documents"), benchmark_words(spark, sf_dir), "doc_id")
    return out.select("doc_id", "total", "in_vocab", F.round("score", 6).alias("score"))


@query(f"WITH lex AS {LEX}, w AS {DOC_WORDS}, k AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM lex) GROUP BY 1, 2) SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_texts FROM k GROUP BY 1")
def oov_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unknown_words(table(spark, sf_dir, "documents"), benchmark_words(spark, sf_dir), "doc_id")


# words of the documents with their first letter changed
CHANGED = r"(SELECT DISTINCT CASE WHEN word LIKE 'q%' THEN 'x' ELSE 'q' END || substr(word, 2) AS query FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}\p{Pc}]+)', 1), lambda w: regexp_matches(w, '^[a-z]+$'))) AS word FROM documents))"


@query(f"WITH lex AS {LEX}, w AS {CHANGED} SELECT query, word, levenshtein(query, word) AS distance, row_number() OVER (PARTITION BY query ORDER BY levenshtein(query, word), word) AS place FROM w JOIN lex ON abs(length(query) - length(word)) <= 2 AND levenshtein(query, word) <= 2")
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z]+)\b"), 1)).alias("word")).distinct()
    asked = own.select(F.concat(F.when(F.col("word").startswith("q"), "x").otherwise("q"), F.col("word").substr(F.lit(2), F.length("word"))).alias("query"))
    return lexicon.similar(asked, benchmark_words(spark, sf_dir), 2).select("query", "word", "distance", "place")


PREFIXES = ("th", "en", "de", "on", "in", "er")


@query(f"WITH lex AS {LEX}, p AS (SELECT unnest({list(PREFIXES)}) AS query) SELECT * FROM (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY word) AS place FROM p JOIN lex ON starts_with(word, query)) WHERE place <= 10")
def prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.with_prefix(spark.createDataFrame([(p,) for p in PREFIXES], "query string"), benchmark_words(spark, sf_dir)).select("query", "word", "place")


CORE = r"'^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$'"
FOLD = lambda x: f"translate({x}, '{ACCENTED}', {BYTES})"


@query(
    f"""WITH lex AS {LEX}, t AS (SELECT conv_id * 1000 + turn AS id, {words_sql("coalesce(text, '')")} AS w FROM conversations), u AS (SELECT id, unnest(w) AS whole, generate_subscripts(w, 1) AS pos FROM t), p AS (SELECT *, regexp_extract(whole, {CORE}, 1) AS head, regexp_extract(whole, {CORE}, 2) AS core, regexp_extract(whole, {CORE}, 3) AS tail FROM u),
s AS MATERIALIZED (SELECT query, {FOLD('query')} AS bytes, unnest(range(length(query) - 1, length(query) + 2)) AS size FROM (SELECT DISTINCT lower(core) AS query FROM p WHERE core <> '' AND lower(core) NOT IN (SELECT word FROM lex))),
n AS (SELECT query, arg_min(word, (levenshtein(bytes, word), word)) AS best FROM s JOIN (SELECT word, length(word) AS size FROM lex) USING (size) WHERE levenshtein(bytes, word) <= 1 GROUP BY 1),
m AS (SELECT p.*, best, sum(CASE WHEN best IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS used FROM p LEFT JOIN n ON lower(core) = query),
c AS (SELECT id, string_agg(head || CASE WHEN best IS NULL OR used > 5 THEN core WHEN upper(core) = core AND lower(core) <> core THEN upper(best) WHEN upper(core[1]) = core[1] AND lower(core[1]) <> core[1] THEN upper(best[1]) || lower(substr(best, 2)) ELSE best END || tail, ' ' ORDER BY pos) AS corrected FROM m GROUP BY 1)
SELECT t.id, coalesce(corrected, '') AS corrected FROM t LEFT JOIN c ON t.id = c.id"""
)
def vocabulary_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return lexicon.correct(turns, benchmark_words(spark, sf_dir), "id")


@query(f"WITH f AS (SELECT unnest(regexp_extract_all(latex, '(\\\\[a-zA-Z]+)', 1)) AS command FROM {LATEX_SQL}) SELECT command FROM f GROUP BY 1 HAVING count(*) >= 2 UNION SELECT unnest(['\\frac', '\\pi'])")
def latex_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.latex_vocabulary(latex_lines(spark, sf_dir), ["\\frac", "\\pi"], 2, "latex")


@query(f"WITH lex AS {LEX}, w AS {DOC_WORDS}, c AS (SELECT doc_id, count(*) AS t, count(lex.word) AS k FROM w LEFT JOIN lex USING (word) GROUP BY 1), s AS (SELECT d.doc_id, d.source, CASE WHEN coalesce(t, 0) = 0 THEN 1.0 ELSE greatest(0, least(1, k / t * 0.3 + 0.7 - (1 - k / t) * 0.1)) END AS v FROM documents d LEFT JOIN c USING (doc_id)) SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY round(0.7 * (doc_id % 10) / 10.0 + 0.3 * v, 9) DESC, doc_id) AS rank FROM s")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    scores = lexicon.coverage(d, benchmark_words(spark, sf_dir), "doc_id")
    rows = d.select("doc_id", "source", ((F.col("doc_id") % 10) / 10.0).alias("model"))
    return lexicon.rerank(rows, scores, "doc_id", "source", "model").select("doc_id", "source", "rank")


# --- geometry and layout ----------------------------------------------------------------------------------------------


@query(f"SELECT page_id, pos, greatest(0, x1 - 5) AS cx1, greatest(0, y1 - 5) AS cy1, least(640, x2 + 5) AS cx2, least(800, y2 + 5) AS cy2, x2 - x1 > 50 AND y2 - y1 > 15 AS kept, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y FROM ({BOXES})")
def clamp_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("b", G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    c = G.clamp(F.col("b"), F.lit(640), F.lit(800))
    return b.select("page_id", "pos", c["x1"].alias("cx1"), c["y1"].alias("cy1"), c["x2"].alias("cx2"), c["y2"].alias("cy2"), G.big_enough(F.col("b"), 50, 15).alias("kept"), G.center_x(F.col("b")).alias("center_x"), G.center_y(F.col("b")).alias("center_y"))


@query(f"SELECT page_id, pos, CAST(trunc(x1 / 1000 * 1700) AS INT) AS px1, CAST(trunc(y2 / 1000 * 2200) AS INT) AS py2, format('{{:d}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', class_id, (x1 + x2) / 2 / 1024, (y1 + y2) / 2 / 1024, (x2 - x1) / 1024, (y2 - y1) / 1024) AS label FROM ({BOXES})")
def yolo_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("b", G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    p = G.from_thousandths(F.col("b"), F.lit(1700), F.lit(2200))
    return b.select("page_id", "pos", p["x1"].alias("px1"), p["y2"].alias("py2"), G.detector_label(F.col("class_id"), F.col("b"), 1024, 1024).alias("label"))


CLUSTERS = f"""WITH RECURSIVE b AS (SELECT page_id, pos, x1, y1, x2, y2, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, pos) AS rn FROM ({BOXES})),
f AS (SELECT page_id, pos, rn, cy AS s, 1 AS n, 0 AS line_no FROM b WHERE rn = 1 UNION ALL SELECT b.page_id, b.pos, b.rn, CASE WHEN abs(b.cy - f.s / f.n) <= {{tol}} THEN f.s + b.cy ELSE b.cy END, CASE WHEN abs(b.cy - f.s / f.n) <= {{tol}} THEN f.n + 1 ELSE 1 END, f.line_no + CASE WHEN abs(b.cy - f.s / f.n) <= {{tol}} THEN 0 ELSE 1 END FROM f JOIN b ON b.page_id = f.page_id AND b.rn = f.rn + 1) """


@query(CLUSTERS.replace("{tol}", "15") + "SELECT b.page_id, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_boxes FROM f JOIN b USING (page_id, rn) GROUP BY 1, 2")
def cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_lines(boxes(spark, sf_dir), 15)


@query(CLUSTERS.replace("{tol}", "20") + "SELECT b.page_id, b.pos, line_no, row_number() OVER (PARTITION BY b.page_id ORDER BY line_no, x1, y1, b.pos) AS rank FROM f JOIN b USING (page_id, rn)")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir), 20).select("page_id", "pos", "line_no", "rank")


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, pos) AS rn FROM ({BOXES})), f AS (SELECT page_id, rn, x2 AS e, class_id, 0 AS part FROM b WHERE rn = 1 UNION ALL
SELECT b.page_id, b.rn, CASE WHEN b.class_id = f.class_id AND b.x1 - f.e <= 20 THEN greatest(f.e, b.x2) ELSE b.x2 END, b.class_id, f.part + CASE WHEN b.class_id = f.class_id AND b.x1 - f.e <= 20 THEN 0 ELSE 1 END FROM f JOIN b ON b.page_id = f.page_id AND b.rn = f.rn + 1)
SELECT b.page_id, part, min(b.class_id) AS class_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(confidence) AS confidence FROM f JOIN b USING (page_id, rn) GROUP BY 1, 2"""
)
def merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_close(boxes(spark, sf_dir))


# folds as recursive statements: one box of each page joins at each step
OVERLAPS = f"""WITH RECURSIVE b AS (SELECT page_id, pos, y1, y2, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, pos) AS rn FROM ({BOXES})), f AS (SELECT page_id, pos, rn, [{{'y1': y1, 'y2': y2, 'no': 0}}] AS seen, 0 AS line_no FROM b WHERE rn = 1 UNION ALL
SELECT page_id, pos, rn, list_append(seen, {{'y1': y1, 'y2': y2, 'no': no}}), no FROM (SELECT b.page_id, b.pos, b.rn, b.y1, b.y2, f.seen, CAST(coalesce(list_min(list_transform(list_filter(f.seen, lambda s: least(b.y2, s.y2) - greatest(b.y1, s.y1) >= 0.5 * least(b.y2 - b.y1, s.y2 - s.y1)), lambda s: s.no)), list_max(list_transform(f.seen, lambda s: s.no)) + 1) AS INT) AS no FROM f JOIN b ON b.page_id = f.page_id AND b.rn = f.rn + 1))
SELECT page_id, pos, line_no FROM f"""


@query(OVERLAPS)
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_lines(boxes(spark, sf_dir)).select("page_id", "pos", "line_no")


MEETS = "greatest(0, least(b.x2, s.x2) - greatest(b.x1, s.x1)) * greatest(0, least(b.y2, s.y2) - greatest(b.y1, s.y1))"
SUPPRESSED = f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, pos) AS rn FROM ({BOXES}) WHERE confidence >= 0.5), f AS (SELECT page_id, pos, rn, confidence, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS stays FROM b WHERE rn = 1 UNION ALL
SELECT page_id, pos, rn, confidence, CASE WHEN stays THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END, stays FROM (SELECT b.*, f.kept, len(list_filter(f.kept, lambda s: {MEETS} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (s.x2 - s.x1) * (s.y2 - s.y1) - {MEETS}) > 0.45)) = 0 AS stays FROM f JOIN b ON b.page_id = f.page_id AND b.rn = f.rn + 1))
SELECT page_id, pos, confidence FROM f WHERE stays"""


@query(SUPPRESSED)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppress(boxes(spark, sf_dir), 0.45, 0.5).select("page_id", "pos", "confidence")


RECON = f"""WITH b AS (SELECT *, (y1 + y2) / 2 AS cy, avg(y2 - y1) OVER (PARTITION BY page_id) AS mh, class_id = 1 AND pos % 3 = 0 AS alone FROM ({BOXES})), g AS (SELECT *, cy - lag(cy) OVER w AS gap, coalesce(lag(alone) OVER w, false) AS after FROM b WINDOW w AS (PARTITION BY page_id ORDER BY cy, pos)),
v AS (SELECT *, coalesce(gap > mh * 2.5, false) AS breaks, sum(CASE WHEN coalesce(gap > mh * 1.5, true) OR alone OR after THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY cy, pos ROWS UNBOUNDED PRECEDING) AS visual FROM g),
l AS (SELECT page_id, visual, CASE WHEN bool_or(breaks) THEN chr(10) ELSE '' END || string_agg(CASE WHEN alone THEN chr(10) || '$$' || chr(10) || text || chr(10) || '$$' || chr(10) WHEN class_id = 1 THEN '$' || text || '$' ELSE text END, ' ' ORDER BY x1, cy, pos) AS line FROM v GROUP BY 1, 2) SELECT page_id, string_agg(line, chr(10) ORDER BY visual) AS document FROM l GROUP BY 1"""


@query(RECON)
def reconstruct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("kind", F.when(F.col("class_id") == 1, "math").otherwise("text")).withColumn("display", F.col("pos") % 3 == 0)
    return layout.documents(rows)


@query("SELECT l_orderkey AS page_id, string_agg('w' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY 1")
def group_concat_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber", "l_partkey", F.concat(F.lit("w"), F.col("l_partkey")).alias("word"))
    return lines.join_words(rows, ["page_id"], ["l_linenumber", "l_partkey"], "word")


@query(f"SELECT page_id, class_id AS line_idx, string_agg(text, ' ' ORDER BY x1, pos) AS text, greatest(0, min(x1) - 10) AS x1, greatest(0, min(y1 - 2) - 10) AS y1, max(x2) + 10 AS x2, max(y2) + 10 AS y2 FROM ({BOXES}) GROUP BY 1, 2")
def poly_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    rows = b.select("page_id", "pos", F.col("class_id").alias("line_idx"), "text", F.col("x1").alias("px0"), F.col("y1").alias("py0"), F.col("x2").alias("px1"), (F.col("y1") - 2).alias("py1"), F.col("x2").alias("px2"), F.col("y2").alias("py2"), F.col("x1").alias("px3"), F.col("y2").alias("py3"))
    return layout.polygons_to_boxes(rows)


# --- manifests and joins ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN n <= floor(a * 0.8 + 1e-9) THEN 'train' WHEN n <= floor(a * 0.8 + 1e-9) + floor(a * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS partition FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS n, count(*) OVER () AS a FROM documents)")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT lang AS mode, count(*) AS n, count(source) AS with_source FROM (SELECT lang, source FROM documents UNION ALL SELECT 'benchmark', NULL FROM benchmark UNION ALL SELECT role, NULL FROM conversations) GROUP BY 1")
def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("mode"), "source")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("mode"))
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("mode"))
    return manifest.union_all(d, b, c).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count("source").alias("with_source"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return manifest.first_of(rows, ["text"], ["doc_id"]).select("text", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").filter("quality = 1")
    return manifest.keep_listed(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = manifest.with_group(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["o_orderkey"], ["o_orderkey"])
    return out.select("c_custkey", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey + 5 = n_nationkey")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select((F.col("n_nationkey") - 5).alias("s_nationkey"), "n_name")  # the last five keys miss
    return manifest.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("SELECT event_id, text AS latex FROM events JOIN benchmark ON event_id % (SELECT count(*) + 20 FROM benchmark) = item_id")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = table(spark, sf_dir, "benchmark")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % (lines_.count() + 20)).alias("idx"))  # some point beyond the lines
    return manifest.by_position(rows, lines_, "idx", "item_id").select("event_id", F.col("text").alias("latex"))


# --- documents --------------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS document_id, count(DISTINCT turn // 4) AS n_pages, count(*) AS n_blocks, string_agg(coalesce(text, ''), '|' ORDER BY turn, role, text) AS texts FROM conversations GROUP BY 1")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.select(F.col("conv_id").alias("document_id"), F.expr("cast(turn div 4 as int)").alias("page_number"), "pos", F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("raw_text"), F.lit("").alias("latex"), F.lit(0.9).alias("confidence"), F.array().cast("array<int>").alias("bounding_box"))
    docs = documents.documents(rows)
    every = F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: b["latex"])))
    return docs.select("document_id", F.size("pages").cast("bigint").alias("n_pages"), F.size(every).cast("bigint").alias("n_blocks"), F.array_join(every, "|").alias("texts"))


@query("SELECT conv_id AS document_id, coalesce(arg_min(nullif(role, ''), turn), 'unknown') AS subject, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', ''))) AS BIGINT) AS total_questions FROM conversations GROUP BY 1")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("role").alias("subject"), F.lit(None).cast("string").alias("grade_level"), X.count_of(F.coalesce("text", F.lit("")), "?").alias("questions"))
    return documents.page_metadata(rows).select("document_id", F.coalesce("subject", F.lit("unknown")).alias("subject"), "total_questions")


@query(f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')) AS n_steps FROM documents")
def solution_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.solution_steps(F.col("text"))).alias("n_steps"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sha_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, strlen(text) AS n_bytes, true AS equal FROM documents WHERE text IS NOT NULL")
def base64_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("b"))
    back = X.image_bytes(F.concat(F.lit("data:image/png;base64,"), F.base64("b")))
    return rows.select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"), (back == F.col("b")).alias("equal"))


# --- logs -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)), 3) AS elapsed FROM events")
def log_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.log_elapsed(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "elapsed")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stage_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, run"
)
def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.session_runs(table(spark, sf_dir, "events"))


@query()
def beam_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    return decoding.decode(table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", steps.alias("logits")), "vec_id", width=4, end=0)
