"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams.

Word unigrams and bigrams fall into hash buckets.  Two multinomials over the
buckets are counted: the raw corpus, from every document, and the trusted
target, from documents labelled good.  A document's score is its mean log ratio
``target / raw``; it is kept if the score reaches a fixed threshold.  Everything
on this path is a Spark SQL expression or aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, id_text_columns

#: White space of the word definition.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityConfig:
    """``buckets`` bounds the weights that go to every task (16,384 doubles).

    ``target_rows``: at most so many labelled documents, those with the least
    hash of their id, form the target sample; its ids are broadcast (160 KB at
    most).  ``smoothing``: tokens of corpus proportion added to each bucket, so
    that buckets with few tokens say nothing.
    """

    buckets: int = 1 << 14
    smoothing: float = 100.0
    threshold: float = -0.05
    target_rows: int = 20_000
    min_words: int = 50
    max_repeat_percent: int = 50


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _word_at(w: Column, i: Column) -> Column:
    return F.element_at(w, i.cast("int"))


def repeat_words(w: Column, hashes: Column) -> Column:
    """Words covered by three-word windows that occur twice or more; ``hashes`` are those of the windows in order.

    Windows are sorted by hash, so equal ones are neighbours; n log n for any text.
    """
    keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def at(s, j):
        return F.get(s, j)["h"]

    twice = lambda s: F.array_sort(
        F.filter(
            F.transform(
                s, lambda x, j: F.when((x["h"] == at(s, j - 1)) | (x["h"] == at(s, j + 1)), x["i"])
            ),
            lambda p: p.isNotNull(),
        )
    )
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
    )["n"]
    # a one-element array binds the sorted windows to a variable
    whole = F.get(F.transform(F.array(keyed), lambda s: covered(twice(s))), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(whole)


def windows(w: Column) -> Column:
    """Hashes of the three-word windows, in order."""
    n = F.size(w)
    return F.when(
        n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(_word_at(w, i), _word_at(w, i + 1), _word_at(w, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(
    df: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of every row.

    Null and empty texts have no words and fail.  Repeated rows stay; other
    columns are left behind, or with ``keep`` come along in a struct ``_row``.
    No shuffle.
    """
    text = F.col("text")
    rows = id_text(df, id_col, text_col)
    if keep:
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *id_text_columns(id_col, text_col))
    counted = rows.withColumn("_w", words(text)).withColumn("_h", windows(F.col("_w")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = counted.select(
        *(["_row"] if keep else []),
        "doc_id",
        "text",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w"), F.col("_h")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < config.min_words) | (
        100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def _features(w: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams."""
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = F.when(
        F.size(w) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - 1),
            lambda i: F.pmod(F.xxhash64(_word_at(w, i), _word_at(w, i + 1)), F.lit(buckets)).cast("int"),
        ),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(single, pairs)


def bucket_weights(df: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col="doc_id", text_col="text") -> DataFrame:
    """``bucket, weight`` for every bucket: the smoothed log ratio of target and corpus shares.

    ``labels`` has ``doc_id`` and ``quality``, and ``toxic`` where known; rows
    with a null id or quality say nothing, and an id labelled more than once
    counts if every label is good.  Without any target, all weights are zero.
    """
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min(F.when((F.col("quality") == 1) & (toxic == 0), 1).otherwise(0)).alias("_good"))
        .where("_good = 1")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(config.target_rows)
        .select("_id")
    )
    docs = id_text(df, id_col, text_col).join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left")
    # the words are a column of their own: inside a lambda they would be cut out again for each place
    split = docs.select(words(F.col("text")).alias("_w"), F.col("_id").isNotNull().cast("long").alias("hit"))
    seen = split.select(F.explode(_features(F.col("_w"), config.buckets)).alias("bucket"), "hit")
    counts = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target"))
    every = df.sparkSession.range(config.buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = F.col("all_target") / F.col("all_raw")
    weight = F.log((F.col("target") + config.smoothing * share) / F.col("all_target")) - F.log(
        (F.col("raw") + config.smoothing) / F.col("all_raw")
    )
    return counts.crossJoin(F.broadcast(total)).select(
        "bucket", F.when(F.col("all_target") > 0, F.round(weight, 9)).otherwise(F.lit(0.0)).alias("weight")
    )


def score(w: Column, weights: list[float], buckets: int) -> Column:
    """Mean weight of a document's n-grams, zero without any."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    found = _features(w, buckets)
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1))
    return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).otherwise(F.lit(0.0))


def judge(
    df: DataFrame,
    labels: DataFrame,
    config: QualityConfig = QualityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """Base counts, ``score`` and ``kept`` of every document; with ``keep`` the input row too, as struct ``_row``.

    The weights, one per bucket whatever the corpus, are fetched once and ride
    in the plan as a constant.
    """
    rows = bucket_weights(df, labels, config, id_col, text_col).orderBy("bucket").collect()
    weights = [r["weight"] for r in rows]
    judged = base_counts(df, config, id_col, text_col, keep).withColumn("score", score(F.col("_w"), weights, config.buckets))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= config.threshold)).drop("_w")
