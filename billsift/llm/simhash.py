"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's
four-word shingles. Two fingerprints that differ in at most four bits share a
midpoint: a value within two bits of both. So each fingerprint emits every
variant within two bits (1 + 64 + 2016 of them), the variants are shuffled, and
fingerprints that meet at a variant are linked.

- Texts are reduced to distinct fingerprints first, so copies cost one row.
- A fingerprint is left out of the emission (unless `prune` is false) only if it provably has no partner:
  of two fingerprints within four bits, two of three parts together differ in at
  most two bits, so both have a common one-bit variant of those two parts (131
  keys a fingerprint). Fingerprints that meet no other at any such key have no
  link.
- All that meet at one variant are within four bits of each other, so each links
  to the least of them: a group of m gives m - 1 links, never m * m. At most
  2081 fingerprints fit around a variant.
- Components: alternating large-star and small-star steps on the links, each
  written to the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, RADIUS = 4, 42, 4
#: All values within two bits of zero.
BALL = np.array(
    [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], dtype=np.uint64
)
EMIT_ROWS = 256
#: The three parts of a fingerprint, as bits from and to.
PARTS = ((0, 21), (21, 42), (42, 64))


def hashes(text: str | None) -> np.ndarray:
    """XXH64 of each shingle of four words (of all words, if there are fewer), as a row of 64 bits."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if n <= SHINGLE:
        shingles = [b" ".join(words)] if n else []
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:]))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint; zero for a text without words (null, empty or blank)."""
    rows = hashes(text)
    if not len(rows):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def fingerprint_column(text: str | Column) -> Column:
    """The fingerprint as a long (its 64 bits, so it may be negative)."""
    return common.text_udf(lambda: lambda text: (signed(fingerprint(text)),), "f long")(text)["f"]


def _part_keys(prints: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint's one-bit variants of each two of its three parts, told apart by a constant."""
    masks = [np.uint64(((1 << 64) - 1) ^ (((1 << (b - a)) - 1) << a)) for a, b in PARTS]
    flips = [np.array([0] + [1 << i for i in range(64) if not a <= i < b], dtype=np.uint64) for a, b in PARTS]
    tags = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(len(PARTS))]

    def make():
        def each(batch):
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), EMIT_ROWS * 16):
                part = fps[at : at + EMIT_ROWS * 16]
                for mask, flip, tag in zip(masks, flips, tags):
                    keys = (part & mask)[:, None] ^ flip ^ tag
                    yield {"variant": keys.ravel().view(np.int64), "fp": np.repeat(part.view(np.int64), len(flip))}

        return each

    return common.map_arrow(prints, make, "variant long, fp long")


def with_partner(prints: DataFrame) -> DataFrame:
    """The fingerprints that may have another one within four bits; those that certainly have none are left out."""
    met = _part_keys(prints).repartition("variant").sortWithinPartitions("variant", "fp")
    return _stars(met).select(F.explode(F.array("a", "b")).alias("fp")).distinct()


def _emit(prints: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint with every variant within two bits."""

    def make():
        def each(batch):
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), EMIT_ROWS):
                part = fps[at : at + EMIT_ROWS]
                yield {"variant": (part[:, None] ^ BALL).ravel().view(np.int64), "fp": np.repeat(part.view(np.int64), len(BALL))}

        return each

    return common.map_arrow(prints, make, "variant long, fp long")


def _stars(met: DataFrame) -> DataFrame:
    """From rows sorted by (variant, fp) within partitions: each variant's least fingerprint with its others."""

    def make():
        last: list = [None, None]

        def each(batch):
            variant = batch.column("variant").to_numpy()
            fp = batch.column("fp").to_numpy()
            if not len(variant):
                return
            start = np.flatnonzero(np.r_[variant[0] != last[0], variant[1:] != variant[:-1]])
            head = np.full(len(variant), -1)
            head[start] = start
            head = np.maximum.accumulate(head)
            first = np.where(head >= 0, fp[np.maximum(head, 0)], last[1] if last[1] is not None else 0)
            keep = fp != first
            last[:] = [variant[-1], first[-1]]
            edges = np.unique(np.stack([first[keep], fp[keep]], axis=1), axis=0)
            yield {"a": edges[:, 0], "b": edges[:, 1]}

        return each

    return common.map_arrow(met, make, "a long, b long")


def links(prints: DataFrame, prune: bool = True) -> DataFrame:
    """(a, b), a < b as longs: links between distinct fingerprints within four bits, at least a spanning tree of each component.

    `prune` leaves out fingerprints that can't have a partner; the links are the same without.
    """
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _emit((with_partner(prints) if prune else prints).repartition(spread, "fp")).repartition("variant").sortWithinPartitions("variant", "fp")
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return _stars(met).distinct().where(far <= RADIUS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the least node that it reaches.

    Large-star and small-star steps in turn until neither changes a link. Each node's neighbours
    are only reduced to their least and joined back, never gathered.
    """
    now = common.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: larger neighbours go to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        small = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        pairs = large.withColumnRenamed("b", "n").join(small, "n")
        step = pairs.select(F.col("m").alias("a"), F.explode(F.array("a", "n")).alias("b")).where("a < b").distinct()
        now = common.written(step, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root"))
            ).distinct()
        seen = state


def _classes(docs: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, root, component) of every distinct fingerprint; both are written tables."""
    marked = common.written(docs.select(F.col(id).alias("id"), fingerprint_column(text).alias("fp")), "prints")
    prints = common.written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(prints.select("fp")))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    return marked, common.written(named.join(names, "root").select("fp", "root", "component"), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Every row's (id, fp, component): component is the least id of all rows reachable over links.

    Texts without words share fingerprint zero. Rows with a null id take part in links, but never name a
    component (a component of null ids only has a null name). Repeated rows and equal texts are one component.
    """
    marked, classes = _classes(docs, text, id)
    return marked.join(classes, "fp").select(F.col("id").alias(id), "fp", "component")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each component of near-duplicates: that of the least id. All columns stay.

    Texts are fingerprinted once, and rows are kept by a semi join on the ids of a written table, so that a text moves at
    most once (not at all while Spark finds the table small enough to broadcast). Null, empty and blank texts share fingerprint
    zero: one of them stays. Of repeated rows with the id that stays and its fingerprint, the one with the least text stays.
    A row with a null id goes if its component has a row with an id; of a component without one, the row with the least text stays.
    """
    marked, classes = _classes(docs, text, id)
    named = marked.where("id IS NOT NULL")
    least = named.join(classes, "fp").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k")).select("k.id", "k.fp")
    times = named.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")
    kept = common.written(least.join(times, "id", "left"), "kept")
    _id, _fp = common.fresh(docs, "kept_id"), common.fresh(docs, "kept_fp")
    once = kept.where("times IS NULL").select(F.col("id").alias(_id))
    out = docs.join(once, docs[id] == once[_id], "left_semi")
    often = kept.where("times IS NOT NULL").select(F.col("id").alias(_id), F.col("fp").alias(_fp))
    if not often.isEmpty():  # ids on several rows: those rows alone are read again
        fp, turn = common.fresh(docs, "fp"), common.fresh(docs, "turn")
        again = docs.join(often, docs[id] == often[_id]).withColumn(fp, fingerprint_column(text)).where(F.col(fp) == F.col(_fp))
        out = out.union(again.withColumn(turn, F.row_number().over(Window.partitionBy(id, fp).orderBy(text))).where(F.col(turn) == 1).select(*docs.columns))
    nameless = common.written(
        marked.where("id IS NULL").select("fp").distinct().join(classes, "fp").where("component IS NULL").select(F.col("fp").alias(_fp), "root"),
        "nameless",
    )
    if not nameless.isEmpty():
        row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
        alone = docs.where(F.col(id).isNull()).select(fingerprint_column(text).alias("fp"), F.coalesce(text, F.lit("")).alias("text"), row)
        met = alone.join(nameless, alone["fp"] == nameless[_fp])
        out = out.union(met.groupBy("root").agg(F.min_by("row", "text").alias("row")).select("row.*"))
    return out


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
