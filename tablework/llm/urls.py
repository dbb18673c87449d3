"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

Only DataFrame functions and Spark ML. The trees are trained on the URLs that a rule judges, on at most ``TRAIN_ROWS`` of
them, which come first by a hash of the URL. What is counted of host suffixes is counted over all URLs, and for a URL
that a rule judges without its own verdict.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 4
FOLDS = 5
# The statistics of a suffix that nothing is known of.
UNKNOWN = -1.0
ALLOW, BLOCK = "allow", "block"

FEATURES = (
    "f_length f_host f_labels f_path f_depth f_digits f_entropy f_parameters f_hyphens f_suffix_share f_suffix_blocked"
).split()


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (verdict, rule), a rule being a host and the beginning of a path, like ``example.com/en/``."""
    made = spark.createDataFrame(rules, "verdict string, rule string")
    host = F.substring_index("rule", "/", 1)
    return made.select("verdict", "rule", host.alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))


def with_parts(urls: DataFrame, url: Column) -> DataFrame:
    """``host`` and ``path`` added: both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = urls.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    out = out.withColumn("raw_host", host)
    path = F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), r"^[^?#]*", 0)
    return out.withColumn("host", C.lower_ascii(F.col("raw_host"))).withColumn("path", path).drop("raw_host", "rest")


def judged_by_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, rule, verdict`` for the staged rows (``row, host, path``) that a rule fits: the longest, a block before
    an allow of the same text.

    A host is joined with the rules under each of its own suffixes, so the work is one equi-join however many rules
    there are.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)),
    )
    fits = (
        rows.filter("host != ''")
        .select("row", "path", F.explode(suffixes).alias("rule_host"))
        .join(C.sized(stage(rules, "rules")), "rule_host")
        .filter(F.expr("startswith(path, rule_path)"))
    )
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    return fits.groupBy("row").agg(best.alias("best")).select("row", "best.rule", "best.verdict")


def with_features(rows: DataFrame) -> DataFrame:
    """The lexical features of a URL that it has by itself, and its host's suffix."""
    length = F.greatest(F.length("url"), F.lit(1))
    entropy = F.expr(
        """aggregate(array_distinct(split(url, '')), 0D, (sum, c) -> sum - if(c = '', 0D,
           (length(url) - length(replace(url, c, ''))) / length(url)
           * log2((length(url) - length(replace(url, c, ''))) / length(url))))"""
    )
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return (
        rows.withColumn("url", F.coalesce("url", F.lit("")))
        .withColumn("f_length", F.length("url").cast("double"))
        .withColumn("f_host", F.length("host").cast("double"))
        .withColumn("f_labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("f_path", F.length("path").cast("double"))
        .withColumn("f_depth", F.size(F.split("path", "/")).cast("double"))
        .withColumn("f_digits", F.length(F.regexp_replace("url", "[^0-9]", "")) / length)
        .withColumn("f_entropy", F.coalesce(entropy, F.lit(0.0)))
        .withColumn("f_parameters", F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")))
        .withColumn("f_hyphens", F.length(F.regexp_replace("url", "[^-]", "")).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )


def with_suffix_statistics(own: DataFrame) -> DataFrame:
    """``f_suffix_share`` and ``f_suffix_blocked`` of the URL's suffix, which is the same for both of an unknown one.

    The share of blocks among the URLs that a rule judges is counted without the row's own fold, so no row sees its own
    label. A suffix that rules judge only one way says nothing but which rule fits, so it counts as unknown, and so does
    half of all other URLs, chosen by a hash, while the trees learn: unknown suffixes then come with both verdicts.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    own = own.withColumn("fold", F.when(F.col("verdict").isNotNull(), fold).otherwise(-1))
    blocks = F.count_if(F.col("verdict") == BLOCK).alias("blocks")
    known = F.count_if(F.col("verdict").isNotNull()).alias("known")
    parts = own.groupBy("suffix", "fold").agg(F.count("*").alias("urls"), blocks, known)
    parts = stage(parts, "suffix_folds")
    whole = parts.groupBy("suffix").agg(*(F.sum(c).alias("all_" + c) for c in ("urls", "blocks", "known")))
    total = parts.agg(F.sum("urls")).first()[0] or 1
    mixed = (F.col("all_blocks") > 0) & (F.col("all_blocks") < F.col("all_known"))
    rest = (F.col("all_blocks") - F.col("blocks") + 1) / (F.col("all_known") - F.col("known") + 2)
    statistics = parts.join(whole, "suffix").select(
        "suffix",
        "fold",
        F.when(mixed, F.col("all_urls") / total).otherwise(UNKNOWN).alias("f_suffix_share"),
        F.when(mixed, F.when(F.col("fold") < 0, (F.col("all_blocks") + 1) / (F.col("all_known") + 2)).otherwise(rest))
        .otherwise(UNKNOWN)
        .alias("f_suffix_blocked"),
    )
    return own.join(C.sized(stage(statistics, "suffixes")), ["suffix", "fold"])


def trained(labelled: DataFrame) -> PipelineModel | float | None:
    """Trees that learn the verdicts of the first ``TRAIN_ROWS`` different URLs by a hash.

    If these have one verdict only, its label (1 for a block); None without any.
    """
    sample = labelled.withColumn("label", (F.col("verdict") == BLOCK).cast("double"))
    sample = sample.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
    withheld = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == 0
    for name in ("f_suffix_share", "f_suffix_blocked"):
        sample = sample.withColumn(name, F.when(withheld, UNKNOWN).otherwise(F.col(name)))
    sample = stage(sample.select("label", *FEATURES).coalesce(1), "sample")
    classes = sorted(r[0] for r in sample.select("label").distinct().collect())
    if len(classes) < 2:
        return classes[0] if classes else None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=0, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(sample)


def scored(own: DataFrame, model: PipelineModel | float | None) -> DataFrame:
    """``block_score`` added."""
    if isinstance(model, PipelineModel):
        return model.transform(own).withColumn("block_score", vector_to_array("probability")[1])
    return own.withColumn("block_score", F.lit(model).cast("double"))


def described(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, host, path``, the rule that fits with its verdict, and features."""
    rows = with_parts(
        pages.select(col(id_column).alias("page_id"), col(url_column).cast("string").alias("url")), F.col("url")
    )
    rows = C.numbered(rows, "row", "urls")
    ruled = stage(judged_by_rules(rows, rules), "ruled")
    return stage(with_suffix_statistics(with_features(rows).join(ruled, "row", "left")), "features")


def filtered(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, block_score``.

    ``rule`` is null where none fits; the verdict is then the trees'. ``block_score`` is their probability of a block,
    null where nothing could be learned. If the rules judge no URL of the table all others are allowed, and if they
    give one verdict only, that is everyone's. A null URL has empty parts, which no rule fits. Repeated rows are judged
    each; no rows in, no rows out.
    """
    own = described(pages, rules, id_column, url_column)
    own = scored(own, trained(own.filter("verdict is not null")))
    learned = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return own.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "block_score"
    )
