"""Ranked lexical search: a set of queries against all documents, by sorted accumulation.

A first pass cuts each document into terms once and keeps those that a query has,
with their frequencies: small rows, written to the shared folder. Counts of
documents and terms come from these. In the second pass a task takes its
documents in chunks: each posting becomes (query, document, impact) for all
queries that hold its term, in concatenated arrays; packed keys of query and
document are radix sorted, sums over equal keys give the scores (reduceat), and
a heap a query keeps the best. A document is whole in its task, so only each
task's best rows move: they are merged in two steps, by ranges of tasks first,
so no merge meets more than a bounded number of rows from each range.

Queries are broadcast in blocks of a bounded number of (query, term) pairs, each
block against all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
BLOCK_PAIRS = 200_000
CHUNK = 2_000_000  # (query, document, impact) triples that are sorted at once, but for one document with more
CHUNK_DOCS = 1 << 16
RANGES = 1000


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(common.ascii_lower(text)) if text else []


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0 on: 16 bits a pass from the lowest, which numpy sorts by radix; a pass in order already is left out."""
    order = np.arange(len(keys))
    for shift in range(0, int(keys.max(initial=0)).bit_length(), 16):
        digit = (keys[order] >> shift).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of the impacts of each."""
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(impacts[order], starts) if len(starts) else impacts


class Block:
    """A block of queries: their ids, terms, and the queries of each term one after the other."""

    def __init__(self, pairs: list[tuple[int | None, str]]):
        self.ids = sorted({q for q, _ in pairs}, key=lambda q: (q is None, q))
        self.terms = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
        at = {q: i for i, q in enumerate(self.ids)}
        held = sorted((self.terms[t], at[q]) for q, t in pairs)
        self.size = np.bincount([t for t, _ in held], minlength=len(self.terms)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.queries = np.array([q for _, q in held], np.int64)


def _blocks(queries: DataFrame, id: str, text: str, block_pairs: int) -> Iterator[Block]:
    cut = common.text_udf(lambda: lambda x: (sorted(set(terms_of(x))),), "terms array<string>")
    pairs = queries.select(F.col(id).cast("long").alias("q"), F.explode(cut(text)["terms"]).alias("t")).distinct()
    pairs = common.written(pairs, "query_terms")
    n = -(-pairs.count() // block_pairs)
    for b in range(n):
        part = pairs.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b) if n > 1 else pairs
        yield Block([tuple(r) for r in part.collect()])


def _matched(docs: DataFrame, block) -> DataFrame:
    """A row for each document with a term: its id, number of terms, and the block's terms in it with their frequencies."""

    def make():
        known = block.value.terms

        def each(batch: pa.RecordBatch):
            ids, counts, terms, tfs = [], [], [], []
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    n = Counter(words)
                    found = n.keys() & known.keys()
                    ids.append(id), counts.append(len(words))
                    terms.append([known[t] for t in found]), tfs.append([n[t] for t in found])
            yield {"doc": ids, "n": counts, "terms": terms, "tfs": tfs}

        return each

    return common.map_arrow(docs, make, "doc bigint, n bigint, terms array<int>, tfs array<bigint>")


def _best(matched: DataFrame, block, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Each task's best documents for each query of the block, with their scores."""

    def make():
        b = block.value
        w = weights.value
        heaps: list[list] = [[] for _ in b.ids]
        floor = np.ones(len(b.ids), np.int64)  # the least score that a query's heap still takes

        def take(docs, n, sizes, terms, tfs):
            at = np.repeat(np.arange(len(docs)), sizes)
            m = 100 - 90 + 90 * n * n_docs // n_terms
            impact = w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[at]))
            queries = b.queries[common.ragged(b.start[terms], b.size[terms])]
            keys, scores = accumulate(queries << 16 | np.repeat(at, b.size[terms]), np.repeat(impact, b.size[terms]))
            queries = keys >> 16
            good = np.flatnonzero(scores >= floor[queries])
            for q, d, s in zip(queries[good].tolist(), (keys[good] & 0xFFFF).tolist(), scores[good].tolist()):
                heap, doc = heaps[q], docs[d]
                row = (s, doc is not None, -doc if doc is not None else 0)
                if len(heap) < top:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
                if len(heap) == top:
                    floor[q] = heap[0][0]

        def each(batch: pa.RecordBatch):
            docs, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists, tfs = batch.column(2), batch.column(3).flatten().to_numpy()
            terms, sizes = lists.flatten().to_numpy(), np.asarray(lists.value_lengths())
            ends = np.cumsum(sizes)
            made = np.r_[0, np.cumsum(b.size[terms])][ends]  # triples up to each document's end
            at = 0
            while at < len(docs):
                before, first = (made[at - 1], ends[at - 1]) if at else (0, 0)
                end = min(max(at + 1, int(np.searchsorted(made, before + CHUNK, "right"))), at + CHUNK_DOCS)
                take(docs[at:end], n[at:end], sizes[at:end], terms[first : ends[end - 1]], tfs[first : ends[end - 1]])
                at = end
            return ()

        def rest():
            rows = [(b.ids[q], -d if known else None, s) for q, heap in enumerate(heaps) for s, known, d in heap]
            yield dict(zip(("query", "doc", "score"), zip(*rows))) if rows else {"query": [], "doc": [], "score": []}

        each.rest = rest
        return each

    return common.map_arrow(matched, make, "query bigint, doc bigint, score bigint").withColumn("range", F.pmod(F.spark_partition_id(), F.lit(RANGES)))


def _kept(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = TOP,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """For each query the `top` documents with the highest scores above 0: query, doc, score, rank (from 1).

    Ids are whole numbers. Rows of one query id are one query with the terms of all; a null id is a query like any
    other. Equal scores go by document id, nulls last; repeated documents are documents of their own. A text that is
    null or has no term finds nothing and is not found; an empty table on either side gives no rows. Other columns are
    not read. A query's own terms (one row's text) must fit in a task.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "query bigint, doc bigint, score bigint, range int")
    docs = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    for held in _blocks(queries, query_id, query_text, block_pairs):
        block = spark.sparkContext.broadcast(held)
        matched = common.written(_matched(docs, block), "matched")
        n_docs, n_terms = matched.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        # one row for each term of the block
        df = matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        w = np.zeros(len(held.terms), np.int64)
        for t, n in df:
            w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        best = _best(matched, block, spark.sparkContext.broadcast(w), n_docs, n_terms, top)
        found = found.unionByName(_kept(best, ["query", "range"], top).drop("rank"))
    return _kept(found, ["query"], top).select("query", "doc", "score", "rank")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents."""
    found = search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
impact AS (SELECT r, t, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * n_docs) // n_terms))) AS x
    FROM f JOIN weight USING (t) JOIN d USING (r), s),
scored AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM impact JOIN q USING (t) JOIN d USING (r) GROUP BY item_id, r, doc_id HAVING sum(x) > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
