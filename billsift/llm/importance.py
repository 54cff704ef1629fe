"""Importance resampling towards a target, over hashed runs of words.

A document's features are all runs of one to three of its words. Each falls into
one of 10,000 buckets by its CRC-32. A bucket's gain is the logarithm of how much
more frequent it is in the target than in the corpus; a document's weight is the
sum of its features' gains, and Gumbel noise from a hash of its id turns the
highest scores into a draw without replacement.

Scoring makes no rows: higher-order functions make each document's bucket array,
and an aggregate adds up element_at of a literal array of the 10,000 gains. Texts
never move. Counting shuffles one total a bucket and task. For the draw, a
histogram of at most a few thousand classes finds how low the drawn scores
reach; only rows above that are sorted, by ranges, and numbered range by range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
RUN = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: What stands between words, in the lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROWS_A_RANGE = 1_000_000
CLASSES = 16  # of scores, for each doubling of their size


def words_column(text: Column) -> Column:
    """The words, A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), common.UPPER, common.UPPER.lower())
    return F.array_remove(F.split(lower, BETWEEN), "")


def buckets_column(words: Column) -> Column:
    """The buckets of all runs of one to RUN words, with repeats; shorter runs first."""

    def of(size: int) -> Column:
        starts = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))) if size > 1 else words
        run = lambda w, i: F.concat(w, *[x for k in range(1, size) for x in (F.lit(" "), F.get(words, i + k))]) if size > 1 else w
        return F.transform(starts, lambda w, i: (F.crc32(run(w, i)) % BUCKETS).cast("int"))

    return F.concat(*[of(k) for k in range(1, RUN + 1)])


def _counted(df: DataFrame, text: str) -> list[int]:
    """How many features each bucket holds: one row a bucket comes to the driver, whatever the table."""
    words = df.select(words_column(F.col(text)).alias("words"))
    found = words.select(F.explode(buckets_column(F.col("words"))).alias("b")).groupBy("b").count()
    out = [0] * BUCKETS
    for b, n in found.collect():
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Each bucket's gain, from the features that corpus and target have in it; an empty table counts as even."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)]


def _class(score: Column) -> Column:
    """A whole number that never falls as the score grows: at most 2 * 64 * CLASSES + 1 different ones."""
    return (F.signum(score) * F.floor(F.log2(F.abs(score) + 1.0) * CLASSES)).cast("int")


def ranked(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row a row of `docs`: its id, n_words, n_features, weight, score and rank (null if not drawn).

    Of the rows with at least `least_words` words, `percent` in a hundred are drawn (rounded down), by score, then id
    (nulls last); repeated rows stay rows of their own, in any order among themselves. A null or empty text has no
    features and weight 0; a null id counts as the empty text in its hash. An empty target or corpus gives even counts.
    Other columns of either table are not read.
    """
    gain = F.split(F.lit(",".join(map(str, gains(_counted(docs, text), _counted(target, text))))), ",").cast("array<bigint>")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    words = docs.select(F.col(id).alias("id"), words_column(F.col(text)).alias("words"), noise.alias("h"))
    weight = F.aggregate(buckets_column(F.col("words")), F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(gain, b + 1))
    n = F.size("words")
    scored = words.select(
        "id", n.cast("long").alias("n_words"), sum(
            (F.greatest(n - k, F.lit(0)) for k in range(1, RUN)), n,
        ).cast("long").alias("n_features"), weight.alias("weight"),
        F.floor(-1000.0 * F.log(-F.log((F.col("h") + 0.5) / 4294967296.0))).alias("noise"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("score", F.col("weight") + F.col("noise")).drop("noise")
    scored = common.written(scored, "scored")

    classes = scored.where(F.col("n_words") >= least_words).groupBy(_class(F.col("score")).alias("c")).count().collect()
    drawn, seen, cut = percent * sum(r["count"] for r in classes) // 100, 0, None
    for r in sorted(classes, key=lambda r: -r["c"]):
        if seen < drawn:
            seen, cut = seen + r["count"], r["c"]
    if cut is None:
        return scored.select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (_class(F.col("score")) >= cut)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    numbered = scored.where(high).repartitionByRange(-(-seen // ROWS_A_RANGE), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = common.written(numbered, "numbered")
    # the upper bits of `at` are the range's number, the lower 33 a row's place in it
    before, total = [], 0
    for r in sorted(numbered.groupBy(F.shiftright("at", 33).alias("range")).count().collect()):
        before.append((r["range"], total))
        total += r["count"]
    starts = docs.sparkSession.createDataFrame(before, "range long, before long")
    placed = numbered.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("range"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1
    columns = [F.col("id").alias(id), "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, F.when(rank <= drawn, rank).alias("rank")).unionByName(
        scored.where(~high).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def resampled(docs: DataFrame, target: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of `docs`, with all their columns; ids should be unique. Rows come in no order."""
    drawn = ranked(docs, target, id, **options).where(F.col("rank").isNotNull()).select(F.col(id).alias("_drawn")).distinct()
    return docs.join(drawn, docs[id].eqNullSafe(drawn["_drawn"]), "left_semi")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and its rank if it is drawn."""
    found = ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is a fold over bytes, each step by a table of 256 numbers that the first lines make.
ORACLE_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS tbl FROM steps WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
words AS (SELECT side, r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f FROM words, range(1, 4) s(n), unnest(range(1, len(w) - n + 2)) t(i)),
counted AS MATERIALIZED (SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(f))) // 2), lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::BIGINT)),
                            lambda c, b: xor(c // 256, tbl[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
totals AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) x(b) LEFT JOIN (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted JOIN hashed USING (f) GROUP BY bucket) y ON b = y.bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
