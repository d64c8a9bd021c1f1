"""Importance resampling on hashed n-grams, seeded samples, caps, splits and mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import bucket, hash32, seeded, tokens
from corpusloom.operators.ranking import apply_cut, cut_by_order, first_by_hash, first_in_order
from corpusloom.session import shared_folder

NGRAM_BUCKETS = 10_000
MICRO = 1_000_000
SKETCH_K = 2_000
SKETCH_MARGIN = 0.01
BROADCAST_KEYS = 5_000_000


def gram_buckets(docs: DataFrame, text: str, buckets: int = NGRAM_BUCKETS) -> Column:
    """The bucket of each unigram and bigram occurrence of a text, over lower-case words and marks; a null text has none.

    An array column holds buckets already, as ``hashed`` leaves them.
    """
    if dict(docs.dtypes)[text].startswith("array"):
        return F.col(text)
    kind = "short" if buckets <= 1 << 15 else "int"  # two bytes a gram, as all grams of a text lie in its row
    place = lambda gram: bucket(gram, buckets).cast(kind)

    def both(t: Column) -> Column:
        after = F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1)))
        # the last token has no successor: its null pair is cut off
        twos = F.zip_with(t, after, lambda a, b: place(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(t, place), F.slice(twos, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))

    # an array of the one token list binds it, so a text is cut once and not at each use
    listed = F.array(tokens(F.lower(F.col(text)), "word_or_mark"))
    return F.coalesce(F.get(F.transform(listed, both), F.lit(0)), F.array().cast(f"array<{kind}>"))


def hashed(docs: DataFrame, id: str, text: str, buckets: int = NGRAM_BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the n-gram buckets in place of the text, settled: texts are cut and hashed once for all later passes.

    Some two bytes a gram are written, which is about the size of the text. ``keep`` names further columns.
    """
    shared_folder(docs.sparkSession)
    return docs.select(id, *(keep or []), gram_buckets(docs, text, buckets).alias(text)).checkpoint()


def ngram_features(docs: DataFrame, id: str, text: str, buckets: int = NGRAM_BUCKETS) -> DataFrame:
    """Hashed n-gram counts per document. A document's rows lie together, so partial counts precede the shuffle."""
    return (
        docs.select(id, F.explode(gram_buckets(docs, text, buckets)).alias("bucket"))
        .groupBy(id, F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )


def bucket_counts(docs: DataFrame, id: str, text: str, name: str, buckets: int) -> DataFrame:
    return (
        docs.select(F.explode(gram_buckets(docs, text, buckets)).alias("bucket"))
        .groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    )


def log_ratios(raw: DataFrame, target: DataFrame, id: str, text: str, target_id: str, target_text: str,
               buckets: int = NGRAM_BUCKETS) -> DataFrame:
    """Per bucket: ln p_target - ln p_raw in millionths, with add-one smoothing.

    Whole millionths make the later sum exact in any order. An empty target gives 0 everywhere.
    At most ``buckets`` rows.
    """
    counts = bucket_counts(raw, id, text, "r", buckets).join(
        bucket_counts(target, target_id, target_text, "t", buckets), "bucket", "full_outer"
    ).select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    # The whole bucket table is one window: at most `buckets` rows.
    whole = W.partitionBy(F.lit(0))
    p_raw = (F.col("r") + 1) / (F.sum("r").over(whole) + buckets)
    p_target = (F.col("t") + 1) / (F.sum("t").over(whole) + buckets)
    ratio = F.round((F.log(p_target) - F.log(p_raw)) * MICRO).cast("long")
    return counts.select("bucket", F.when(F.sum("t").over(whole) == 0, 0).otherwise(ratio).alias("micro"))


def importance_weights(raw: DataFrame, ratios: DataFrame, id: str, text: str,
                       buckets: int = NGRAM_BUCKETS) -> DataFrame:
    """``(id, micro)``: the sum of a document's log ratios, in millionths; 0 for a document without tokens.

    The ratio table has at most ``buckets`` rows, so each task gets it as one array. A text is summed where its buckets lie, and
    only (id, sum) is shuffled, for rows that share an id.
    """
    # a row per bucket, in order, as one array: `buckets` numbers of 8 bytes
    every = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(ratios, "bucket", "left")
    rows = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("micro", F.lit(0).cast("long")).alias("micro"))))
    table = every.agg(F.transform(rows, lambda r: r["micro"]).alias("table")).scalar()
    placed = raw.select(id, gram_buckets(raw, text, buckets).alias("_b"), table.alias("_table"))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + F.get("_table", b.cast("int")))
    return placed.select(id, total.alias("micro")).groupBy(id).agg(F.sum("micro").alias("micro"))


def gumbel_micro(seed: int | str, key: Column) -> Column:
    """Gumbel noise in millionths from the hash of seed and key."""
    u = (hash32(seeded(seed, key)) + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.round(-F.log(-F.log(u)) * MICRO).cast("long")


def resample_keys(weights: DataFrame, id: str, n: int, seed: int | str) -> DataFrame:
    """``(id, score)`` of the ``n`` documents with the largest weight plus noise, ties by id.

    A quantile sketch, merged from one per task, gives a band of scores around the n-th; rows below are counted, and
    only the band (some 2 * SKETCH_MARGIN of the rows, and those that share its scores) is ranked by a distributed sort. The
    counts tell whether the n-th row lies in the band; if ever not, all rows are the band. The result is exact.
    """
    # Ascending key: the best score is the smallest. The narrow keys are kept, as the n-gram pass behind them is long.
    shared_folder(weights.sparkSession)
    keyed = weights.select(id, (-(F.col("micro") + gumbel_micro(seed, F.col(id)))).alias("_neg")).checkpoint()
    rows, sketch = keyed.agg(F.count(F.lit(1)), F.kll_sketch_agg_bigint("_neg", SKETCH_K)).first()
    if n <= 0 or rows <= n:
        return (keyed.limit(0) if n <= 0 else keyed).select(id, (-F.col("_neg")).alias("score"))
    ranks = [min(max(n / rows + m, 0.0), 1.0) for m in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    quantiles = [F.kll_sketch_get_quantile_bigint(F.lit(bytes(sketch)), F.lit(r)) for r in ranks]
    low, high = keyed.sparkSession.range(1).select(*quantiles).first()
    below, upto = keyed.agg(F.count_if(F.col("_neg") < low), F.count_if(F.col("_neg") <= high)).first()
    sure, band = keyed.where(F.col("_neg") < low), keyed.where(F.col("_neg").between(low, high))
    if not below <= n <= upto:
        sure, band, below = keyed.limit(0), keyed, 0
    cut = cut_by_order(band, [], ["_neg", id], F.lit(n - below))
    kept = sure.unionByName(apply_cut(band, cut, [], ["_neg", id], [id]))
    return kept.select(id, (-F.col("_neg")).alias("score"))


def resample(raw: DataFrame, target: DataFrame, id: str, text: str, target_id: str, target_text: str,
             n: int, seed: int | str = 42, buckets: int = NGRAM_BUCKETS, min_chars: int = 0, grams: DataFrame | None = None) -> DataFrame:
    """``n`` raw documents drawn without replacement by importance weight (Gumbel top-n).

    Raw texts are cut into n-grams once; ratios and weights are two passes over their buckets. ``grams`` is ``hashed(raw, ...)`` where the
    caller has it; the target may be rows of such a table too.

    Up to BROADCAST_KEYS drawn ids and scores (16 bytes each for number ids) go to the documents as a broadcast, so the
    texts are filtered where they lie; a larger draw is joined by shuffle.
    """
    pool = raw.where(F.length(text) >= min_chars) if min_chars else raw
    if grams is None:
        grams = hashed(raw, id, text, buckets)
    ratios = log_ratios(grams, target, id, text, target_id, target_text, buckets)
    drawable = hashed(pool, id, text, buckets) if min_chars else grams
    keys = resample_keys(importance_weights(drawable, ratios, id, text, buckets), id, n, seed)
    numbers = dict(raw.dtypes)[id] in ("bigint", "int")
    return pool.join(F.broadcast(keys) if numbers and n <= BROADCAST_KEYS else keys, id)


def sample_n(df: DataFrame, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """Repeatable shuffle-and-take of n rows."""
    return first_by_hash(df, n, hash32(seeded(seed, F.col(key))), key)


def cap_per_source(df: DataFrame, cap: int, source: str, key: str, seed: int | str = 42) -> DataFrame:
    """At most ``cap`` rows of each source, by hash order; smaller sources pass whole."""
    return first_by_hash(df, cap, hash32(seeded(seed, F.col(key))), key, [source])


def head_fraction(df: DataFrame, fraction: float, source: str, key: str) -> DataFrame:
    """The first part of each source in its own order."""
    return first_in_order(df, F.floor(F.col("n") * F.lit(fraction)), [key], [source])


def head_n(df: DataFrame, n: int, key: str, by: list[str] | None = None) -> DataFrame:
    return first_in_order(df, F.lit(n), [key], by)


def sample_sources(df: DataFrame, n: int, source: str, seed: int | str = 42) -> DataFrame:
    """All rows of ``n`` sources picked by hash order. The pick is n rows, hence broadcast."""
    picked = df.select(source).distinct().orderBy(hash32(seeded(seed, F.col(source))), source).limit(n)
    return df.join(F.broadcast(picked), source, "left_semi")


def concat_sources(parts: list[DataFrame], keep: str = "text") -> DataFrame:
    """Union of tables with differing columns, cut down to one column before the union."""
    return reduce(DataFrame.unionByName, [p.select(keep) for p in parts])


def is_validation(key: Column, percent: int = 1, seed: int | str = 42) -> Column:
    """Hold-out membership: depends on the key alone, so it is stable across layouts and reruns."""
    return bucket(seeded(seed, key), 100) < percent
