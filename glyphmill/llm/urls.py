"""URL filter: allow and block rules by host and path, and boosted trees on lexical features for the rest.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. A rule fits its host and all subdomains of it
where the path starts with the rule's; the longest fitting rule decides. All other URLs get the verdict of gradient-boosted trees on length, depth, digit
ratio, entropy, parameter counts, hyphens and labels of the host, and the block rate of the host's suffix among the labelled URLs.

The trees are trained from labelled URLs (a table of at most LABELLED rows; `seed_labels` gives the one that is shipped, made by rule so that no trait decides alone) and then
compiled into one SQL expression, so that scoring is a projection inside the scan's stage; there is no Python on the executors.

Null URLs and those without `://` have an empty host and path, no rule, and are judged by the trees like any other (null as empty text). Repeated rows get equal results; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled rows used at most, rounds of boosting and depth of its trees, and suffixes with a rate of their own.
LABELLED, ROUNDS, DEPTH, SUFFIXES = 20_000, 20, 4, 1000
FEATURES = ("length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def entropy(text: Column) -> Column:
    """Bits per character."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    return F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def features(url: Column, rates: dict[str, float], prior: float) -> list[Column]:
    """In the order of FEATURES."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(text), path_of(text)
    count = lambda c, what: (F.length(c) - F.length(F.translate(c, what, ""))).cast("double")
    query = F.when(F.instr(text, "?") > 0, F.regexp_replace(text, r"^[^?]*\?", "")).otherwise(F.lit(""))
    params = F.when(query == "", 0.0).otherwise(1.0 + count(query, "&"))
    rate = F.lit(prior)
    if rates:
        rate = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[suffix_of(host)], F.lit(prior))
    n = F.length(text).cast("double")
    digits = F.when(n > 0, count(text, "0123456789") / n).otherwise(0.0)
    return [n, count(path, "/"), digits, F.when(n > 0, entropy(text)).otherwise(0.0), params, count(host, "-"), F.when(host == "", 0.0).otherwise(1.0 + count(host, ".")), rate]


#: Labels made by rule: rows, and how often a drawn trait is that of the other kind.
SEED_ROWS, SEED_NOISE = 6000, 0.12
#: What seed hosts end in (reserved names only), with the share of blocked rows among its draws.
SEED_SUFFIXES = (("example.com", 4), ("example.net", 5), ("example.org", 3), ("test", 2), ("invalid", 8), ("example", 5))


def seed_rows(n: int = SEED_ROWS, seed: int = 5) -> list[tuple[str, int]]:
    """(url, label) rows by rule, label 1 for block: every other row is a bad one.

    Each trait (suffix, hyphens, labels of the host, depth, digits, random tokens, parameters) is drawn for itself, more of it for bad rows, and SEED_NOISE of the draws are made as for the other kind.
    So every trait tells something, and none decides."""
    rng = random.Random(seed)
    bad = ("casino", "pills", "bets", "adult", "track", "spam", "win", "cheap", "free", "farm", "ads", "loan")
    good = ("news", "library", "school", "garden", "museum", "weather", "city", "music", "history", "science", "kitchen", "travel")
    soup = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(n):
        label = i % 2
        drawn = lambda: label ^ (rng.random() < SEED_NOISE)  # noqa: B023, E731
        pick = lambda kind, much, little: rng.choice(much if kind else little)
        suffix = rng.choices([x for x, _ in SEED_SUFFIXES], [share if drawn() else 10 - share for _, share in SEED_SUFFIXES])[0]
        words = bad if drawn() else good
        name = "-".join(rng.choice(words) for _ in range(pick(drawn(), (1, 2, 2, 3), (1, 1, 1, 1, 1, 2))))
        if drawn() and rng.random() < 0.5:
            name += "".join(rng.choice(soup) for _ in range(rng.randint(3, 12)))
        sub = "".join(rng.choice(("www", "m", "cdn", "go", "blog", "login")) + "." for _ in range(pick(drawn(), (0, 1, 2, 3), (0, 0, 1, 1))))
        path = "".join("/" + (str(rng.randint(1, 10 ** pick(drawn(), (4, 6, 9), (1, 2, 3)))) if rng.random() < 0.4 else "".join(rng.choice(soup) for _ in range(rng.randint(6, 20))) if drawn() and rng.random() < 0.5 else rng.choice(good)) for _ in range(pick(drawn(), (1, 3, 4, 6), (1, 1, 2, 3))))
        params = "&".join(f"{rng.choice(('id', 'sid', 'ref', 'page', 'utm_source', 'q'))}={rng.randint(1, 10 ** rng.randint(1, 6))}" for _ in range(pick(drawn(), (0, 2, 3, 5), (0, 0, 1, 2))))
        rows.append((f"{rng.choice(('http', 'https'))}://{sub}{name}.{suffix}{path}{'?' + params if params else ''}", label))
    return rows


def seed_labels(spark: SparkSession) -> DataFrame:
    """The shipped labels as a table."""
    return spark.createDataFrame(seed_rows(), "url string, label int")


def suffix_rates(labelled: DataFrame) -> tuple[dict[str, float], float]:
    """Block rate of each frequent suffix, drawn towards that of all rows as if ten more rows had it; and that of all rows."""
    label = F.col("label").cast("double")
    n, bad = labelled.agg(F.count(F.lit(1)), F.sum(label)).first()
    prior = bad / n if n else 0.0
    rows = labelled.groupBy(suffix_of(host_of(F.coalesce("url", F.lit("")))).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("bad")).orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    return {r.suffix: (r.bad + 10 * prior) / (r.n + 10) for r in rows}, prior


class UrlModel:
    """Boosted trees as a SQL expression: margin(url) > 0 means block."""

    def __init__(self, trees: list, weights: list[float], rates: dict[str, float], prior: float) -> None:
        self.trees, self.weights, self.rates, self.prior = trees, weights, rates, prior

    @classmethod
    def fit(cls, labelled: DataFrame) -> "UrlModel":
        """labelled: (url, label 0 or 1); LABELLED rows of smallest hash are used. With one label only, the margin is constant."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = labelled.filter("label is not null").select(F.coalesce("url", F.lit("")).alias("url"), "label").orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED)
        rates, prior = suffix_rates(rows)
        if prior in (0.0, 1.0):
            return cls([("leaf", 2 * prior - 1)], [1.0], rates, prior)
        table = rows.select(F.col("label").cast("double").alias("label"), *[c.alias(f) for f, c in zip(FEATURES, features(F.col("url"), rates, prior), strict=True)])
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("label", "features").coalesce(1)
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=11, minInstancesPerNode=5).fit(table)
        return cls([cls.walk(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), rates, prior)

    @classmethod
    def walk(cls, node) -> tuple:
        if node.getClass().getSimpleName() == "LeafNode":
            return ("leaf", float(node.prediction()))
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), cls.walk(node.leftChild()), cls.walk(node.rightChild()))

    def value(self, row: list[float]) -> float:
        """The margin of one feature row, for tests."""
        total = 0.0
        for tree, weight in zip(self.trees, self.weights, strict=True):
            while tree[0] != "leaf":
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            total += weight * tree[1]
        return total

    def margin(self, columns: list[Column]) -> Column:
        def expression(tree: tuple) -> Column:
            if tree[0] == "leaf":
                return F.lit(tree[1])
            return F.when(columns[tree[0]] <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + F.lit(weight) * expression(tree)
        return total


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) for every page."""
    model = UrlModel.fit(labelled)
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), *[c.alias(f) for f, c in zip(FEATURES, features(url, model.rates, model.prior), strict=True)])
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), model.margin([F.col(f) for f in FEATURES]).alias("margin"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")
