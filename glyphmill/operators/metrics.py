"""Quality of recognizers: error rates over pairs, comparison of engines and checkpoints, reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import distance as D
from glyphmill.session import staged


def upper_median(df: DataFrame, keys: list[str], value: str, ranges: int = 1024) -> DataFrame:
    """(keys, median): the upper median by ranks, without gathering a group in one place.

    Each group's span from least to most is cut in ranges; their counts (at most `ranges` rows for each group) tell the one in which the middle lies, and only
    the distinct values of that range are ranked. df is read four times: a costly one should be staged before."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    one = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in one])
    span = rows.groupBy(*one).agg(F.min("_v").cast("double").alias("_low"), F.max("_v").cast("double").alias("_high"), F.count(F.lit(1)).alias("_n"))
    known = (lambda df: df) if keys else F.broadcast  # without keys one row
    wide = F.col("_high") - F.col("_low")
    place = F.when(wide > 0, F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_low")) / wide * ranges))).otherwise(0)
    ranged = rows.alias("r").join(known(span.alias("s")), same("r", "s")).select("r.*", "_n", place.alias("_range"))
    counts = ranged.groupBy(*one, "_range").agg(F.count(F.lit(1)).alias("_in"), F.first("_n").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_in").over(W.partitionBy(*one).orderBy("_range")))
    middle = upto.filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*one).agg(F.min_by(F.struct("_range", (F.col("_upto") - F.col("_in")).alias("_before"), "_n"), "_range").alias("_m"))
    inside = ranged.alias("r").join(known(middle.alias("m")), same("r", "m") & (F.col("_range") == F.col("_m._range"))).select("r.*", F.col("_m._before").alias("_before"))
    ranked = inside.groupBy(*one, "_v", "_before", "_n").agg(F.count(F.lit(1)).alias("_k"))
    ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_k").over(W.partitionBy(*one).orderBy("_v")))
    return ranked.filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*one).agg(F.min("_v").alias("median")).select(*keys, "median")


def pairs_with_rates(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    p, r = F.col(prediction), F.col(reference)
    return pairs.withColumn("cer", D.cer(p, r)).withColumn("wer", D.wer(p, r)).withColumn("exact", D.stripped(p) == D.stripped(r))


def corpus_summary(rated: DataFrame) -> DataFrame:
    """One row: means, upper medians, exact rate and n; zeros when empty."""
    rated = staged(rated.select("cer", "wer", "exact"), "rates")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = rated.agg(zero(F.avg("cer")).alias("mean_cer"), zero(F.avg("wer")).alias("mean_wer"), zero(F.avg(F.col("exact").cast("int"))).alias("exact_rate"), F.count(F.lit(1)).alias("n"))
    for name in ("cer", "wer"):
        middle = upper_median(rated, [], name)
        means = means.crossJoin(middle.agg(zero(F.min("median")).alias(f"median_{name}")))  # one row each
    return means


def batch_summary(rated: DataFrame) -> DataFrame:
    """One row: means and sample deviations of rates rounded to four places."""
    one = lambda n: [F.round(F.coalesce(F.avg(F.round(n, 4)), F.lit(0.0)), 4).alias(f"mean_{n}"), F.round(F.coalesce(F.stddev_samp(F.round(n, 4)), F.lit(0.0)), 4).alias(f"std_{n}")]
    return rated.agg(*one("cer"), *one("wer"), F.count(F.lit(1)).alias("n"))


def math_summary(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """One row over formula pairs: mean and upper median of the normalized token distance, edits, tokens, micro accuracy, exact rate."""
    p, r = D.latex_tokens(F.col(prediction)), D.latex_tokens(F.col(reference))
    rows = pairs.select(p.alias("p"), r.alias("r"), D.exact_expression(F.col(prediction), F.col(reference)).alias("exact"))
    rows = rows.withColumn("edits", D.sequence_distance(F.col("p"), F.col("r"))).withColumn("rate", D.normalized_distance(F.col("edits"), F.size("r"), F.size("p")))
    rows = staged(rows.select("rate", "edits", F.size("r").alias("tokens"), "exact"), "rates")
    micro = 1.0 - F.try_divide(F.sum("edits"), F.sum("tokens"))
    middle = upper_median(rows, [], "rate").agg(F.coalesce(F.min("median"), F.lit(0.0)).alias("median_distance"))
    return middle.crossJoin(rows.agg(F.avg("rate").alias("mean_distance"), F.sum("edits").alias("edits"), F.sum("tokens").alias("tokens"), F.coalesce(micro, F.lit(0.0)).alias("micro_accuracy"), F.avg(F.col("exact").cast("int")).alias("exact_rate"), F.count(F.lit(1)).alias("n")))  # one row each


def compare_engines(samples: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """(engine, mean_cer, mean_wer, exact_rate, n) from (sample_id, reference, predictions map). Engines are those of the first sample, if not named; a missing prediction is an empty text."""
    if engines is None:
        first = samples.orderBy("sample_id").select(F.map_keys("predictions")).first()
        engines = sorted(first[0]) if first else []
    rows = samples.select("sample_id", "reference", F.explode(F.array(*[F.lit(e) for e in engines]) if engines else F.array().cast("array<string>")).alias("engine"), "predictions")
    rows = rows.withColumn("prediction", F.coalesce(F.col("predictions")[F.col("engine")], F.lit("")))
    return pairs_with_rates(rows).groupBy("engine").agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.avg(F.col("exact").cast("int")).alias("exact_rate"), F.count(F.lit(1)).alias("n"))


def best(metrics: DataFrame, name: str, metric: str, largest: bool = False) -> DataFrame:
    """The row with the best metric; rows without one are skipped, of equals the first by name wins."""
    order = F.desc(metric) if largest else F.asc(metric)
    return metrics.filter(F.col(metric).isNotNull()).orderBy(order, name).limit(1)


def report(metrics: DataFrame, columns: tuple[str, ...] = ("mean_cer", "mean_wer", "exact_rate")) -> DataFrame:
    """One row: a Markdown table of engines by mean error."""
    titles = {"mean_cer": "CER", "mean_wer": "WER", "exact_rate": "exact"}
    heads = ["engine", *(titles[c] for c in columns), "n"]
    line = F.format_string("| %s | " + "%.4f | " * len(columns) + "%d |", "engine", *columns, "n")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("mean_cer", "engine", line.alias("line")))), lambda r: r["line"])
    head = F.array(F.lit("| " + " | ".join(heads) + " |"), F.lit("| " + " | ".join(["---"] * len(heads)) + " |"))
    return metrics.agg(F.array_join(F.concat(head, lines), "\n").alias("report"))


def page_summary(lines: DataFrame, page: str, boost: Column | None = None) -> DataFrame:
    """(page, accepted, retry, failed, overall): counts of tags, and the mean confidence of lines that did not fail, plus the page's boost."""
    mean = F.coalesce(F.avg(F.when(F.col("tag") != "FAILED_EXTRACTION", F.col("confidence"))), F.lit(0.0))
    total = mean + (boost if boost is not None else F.lit(0.0))
    tags = [F.count_if(F.col("tag") == t).alias(n) for n, t in (("accepted", "ACCEPTED"), ("retry", "RETRY_REQUIRED"), ("failed", "FAILED_EXTRACTION"))]
    return lines.groupBy(page).agg(*tags, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("overall"))


#: Metrics of a checkpoint by the kind of its model: name -> (prediction, reference) -> Column.
METRICS: dict[str, dict[str, Callable[[Column, Column], Column]]] = {
    "text": {"cer": D.cer, "wer": D.wer},
    "math": {"token_distance": lambda p, r: D.normalized_distance(D.sequence_distance(D.latex_tokens(p), D.latex_tokens(r)), F.size(D.latex_tokens(r)), F.size(D.latex_tokens(p))), "exact": lambda p, r: D.exact_expression(p, r).cast("double")},
}


def checkpoint_means(rows: DataFrame, kind: str = "text", checkpoint: str = "checkpoint") -> DataFrame:
    """(checkpoint, mean_<metric> ..., num_evaluated): over rows with a prediction only; a checkpoint of which none succeeded has nulls and 0."""
    p, r = F.col("prediction"), F.col("reference")
    rated = rows.select(checkpoint, p.isNotNull().alias("ok"), *[F.when(p.isNotNull(), metric(p, r)).alias(name) for name, metric in METRICS[kind].items()])
    return rated.groupBy(checkpoint).agg(*[F.avg(name).alias(f"mean_{name}") for name in METRICS[kind]], F.count_if("ok").alias("num_evaluated"))


def merged_metrics(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, metrics): two tables (key, metrics map) in one; of equal names the second counts."""
    both = a.select(key, F.col("metrics").alias("_a")).join(b.select(key, F.col("metrics").alias("_b")), key, "full")
    none = F.create_map().cast(b.schema["metrics"].dataType)
    old = F.map_filter(F.coalesce("_a", none), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("_b"), k), F.lit(False)))
    return both.select(key, F.map_concat(old, F.coalesce("_b", none)).alias("metrics"))


def counts_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: how many rows hold each of the values (regions by type, samples by loader)."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
