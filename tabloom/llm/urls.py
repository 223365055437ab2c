"""URL filter: rules where they fit, gradient-boosted trees on lexical features elsewhere.

Everything is an expression over the URL: host, path, the longest rule that fits, and the features the
trees see (lengths, depth, digits, entropy, parameters, and how often URLs of the same suffix and the
same first path segment were blocked among the labelled ones). The trees are Spark's own.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER
from tabloom.operators.ordering import broadcast_if_small
from tabloom.session import cut_lineage

# The rules.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
TRAIN_ROWS = 20_000  # labelled URLs that the trees are fitted on, at most
FOLDS = 16  # a labelled URL sees the rates of the fifteen others
TREES = 12
DEPTH = 4
SEED = 7
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens",
    "entropy", "parameters", "query_length", "suffix_rate", "suffix_count", "segment_rate",
)


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a URL; null or no ``://`` leaves all empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return {
        "host": F.translate(host, UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones the first listed."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment(path: Column) -> Column:
    """The first path segment."""
    return F.substring_index(F.substring(path, 2, 1 << 30), "/", 1)


def _entropy(text: Column) -> Column:
    """Bits per character of the characters' frequencies."""
    chars = F.split(text, "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: (n - F.size(F.array_remove(chars, c))).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column, query: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    digits = lambda c: (F.length(c) - F.length(F.translate(c, "0123456789", ""))).cast("double")
    count = lambda c, x: (F.length(c) - F.length(F.translate(c, x, ""))).cast("double")
    return {
        "url_length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digit_ratio": digits(text) / F.greatest(F.length(text), F.lit(1)),
        "host_digits": digits(host),
        "hyphens": count(host, "-"),
        "entropy": _entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query).cast("double"),
    }


KEYS = {"_s": lambda: suffix(F.col("host")), "_g": lambda: segment(F.col("path"))}


class Rates:
    """How many of all labelled URLs have a suffix or first segment, and how many of them are blocked."""

    def __init__(self, urls: DataFrame, key: str):
        self.key = key
        self.by_fold = cut_lineage(urls.groupBy(KEYS[key]().alias(key), "_f").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")))
        self.all = cut_lineage(self.by_fold.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
        self.rows, self.fold_rows = self.all.count(), self.by_fold.count()

    def join(self, rows: DataFrame, own_fold: bool) -> DataFrame:
        """Adds the counts; of labelled rows, without those of the row's own fold, so that no label tells itself."""
        named = self.all.select(self.key, F.col("n").alias(f"{self.key}_n"), F.col("b").alias(f"{self.key}_b"), F.col("n").alias(f"{self.key}_all"))
        out = rows.join(broadcast_if_small(named, self.rows), self.key, "left")
        if not own_fold:
            return out
        less = self.by_fold.withColumnsRenamed({"n": "_ln", "b": "_lb"})
        out = out.join(broadcast_if_small(less, self.fold_rows), [self.key, "_f"], "left")
        rest = {c: F.col(c) - F.coalesce(F.col(x), F.lit(0)) for c, x in ((f"{self.key}_n", "_ln"), (f"{self.key}_b", "_lb"))}
        return out.withColumns(rest).drop("_ln", "_lb")


class UrlModel:
    """Fitted trees with the block rates of suffixes and first segments."""

    def __init__(self, trees: GBTClassificationModel | None, rates: dict[str, Rates], overall: float):
        self.trees, self.rates, self.overall = trees, rates, overall

    def features(self, judged: DataFrame, own_fold: bool = False) -> DataFrame:
        """Adds the features to rows with u, host, path, query; labelled rows (``own_fold``) have their fold in ``_f``."""
        out = judged.withColumns({k: of() for k, of in KEYS.items()})
        for rate in self.rates.values():
            out = rate.join(out, own_fold)
        smooth = lambda k: (F.coalesce(F.col(f"{k}_b"), F.lit(0.0)) + 10 * F.lit(self.overall)) / (F.coalesce(F.col(f"{k}_n"), F.lit(0)) + 10)
        lex = lexical(F.col("u"), F.col("host"), F.col("path"), F.col("query"))
        stats = {"suffix_rate": smooth("_s"), "suffix_count": F.log1p(F.coalesce(F.col("_s_all"), F.lit(0)).cast("double")), "segment_rate": smooth("_g")}
        return out.withColumns(lex | stats)

    def blocks(self, judged: DataFrame) -> DataFrame:
        """Adds ``blocked`` (boolean), the trees' verdict."""
        if self.trees is None:
            return judged.withColumn("blocked", F.lit(self.overall >= 0.5))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(self.features(judged))
        return self.trees.transform(ready).withColumn("blocked", F.col("_blocked") == 1.0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Trees for rows (u, host, path, query, label: 1.0 block, 0.0 allow).

    Suffixes and segments are counted over all labelled URLs, each once however often it occurs; only
    the trees are fitted on a bounded sample, the ``train_rows`` URLs of the smallest hashes, which see
    the counts of the other folds. With labels of one kind only, or none, the model says that kind, or allow.
    """
    once = labelled.groupBy("u").agg(*[F.any_value(c).alias(c) for c in ("host", "path", "query")], F.max("label").alias("label"))
    once = cut_lineage(once.withColumn("_f", F.pmod(F.xxhash64(F.lit("fold"), "u"), F.lit(FOLDS)).cast("int")))
    n, blocked = once.agg(F.count(F.lit(1)), F.sum("label")).first()
    overall = (blocked or 0.0) / n if n else 0.0
    rates = {k: Rates(once, k) for k in KEYS}
    picked = once.orderBy(F.xxhash64("u"), "u").limit(train_rows)
    model = UrlModel(None, rates, overall)
    if overall in (0.0, 1.0):
        return model
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(model.features(picked, own_fold=True)).select("_x", "label")
    gbt = GBTClassifier(
        featuresCol="_x", labelCol="label", predictionCol="_blocked",
        maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED, maxBins=64,
    )
    model.trees = gbt.fit(cut_lineage(table))
    return model


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict (allow or block).

    ``labelled`` (url, label: true to block) trains the trees; by default the URLs that rules decide
    are the labelled ones. Null urls and urls without ``://`` have an empty host and path. A null or
    repeated page_id is passed on; other columns are not read.
    """
    p = parts(F.col("u"))
    split = lambda df: df.withColumns(p)
    rows = split(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u")))
    ruled = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.where("_rule is not null").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    else:
        known = split(labelled.select(F.col("url").cast("string").alias("u"), F.col("label").cast("double").alias("label"))).where("u is not null")
    judged = fit(known).blocks(ruled)
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"))
