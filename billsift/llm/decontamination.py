"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

The benchmark's questions and answers are cut into windows of ten words (an
item of fewer words is one window). One automaton holds all windows and reads
each document's normalised text once, left to right; each match is mapped back
to word numbers and to offsets in the original text.

The automaton is broadcast as its list of windows. Its size has a bound: a
benchmark of more than BLOCK_CHARS characters is cut into blocks by a hash of
its windows, and the documents are scanned once a block; hits of the blocks
are merged row by row, without a shuffle, so no item is ever left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

WINDOW = 10
BLOCK_CHARS = 16_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "n_words bigint, hits array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, n_hit bigint, items array<bigint>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(common.ascii_lower(text)) if text else []


def windows_of(text: str | None) -> set[str]:
    """The windows of an item, each with a blank on either side; none for an item without words."""
    words = words_of(text)
    return {f" {' '.join(words[i : i + WINDOW])} " for i in range(max(len(words) - WINDOW, 0) + 1)} if words else set()


def automaton(windows: Iterable[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for window, items in windows:
        out.add_word(window, (window.count(" ") - 1, items))
    if len(out):
        out.make_automaton()
    return out


def scanner(found: ahocorasick.Automaton):
    """The function from a text and the hits of earlier blocks to a FOUND tuple."""

    def scan(text: str | None, before=None):
        words = words_of(text)
        spans: list[tuple[int, int]] = [(h["first"], h["last"]) for h in before["hits"]] if before else []
        items: set[int] = set(before["items"]) if before else set()
        if words and len(found):
            flat = f" {' '.join(words)} "
            ends = None
            for end, (n, ids) in found.iter(flat):
                if ends is None:  # word number by the place of the blank after it
                    ends, at = {}, 0
                    for i, w in enumerate(words):
                        at += len(w) + 1
                        ends[at] = i
                last = ends[end]
                spans.append((last - n + 1, last))
                items.update(ids)
        merged: list[list[int]] = []
        for first, last in sorted(spans):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(last, merged[-1][1])
            else:
                merged.append([first, last])
        hits = []
        if merged:
            place = [m.span() for m in WORD.finditer(common.ascii_lower(text))]
            hits = [{"first": a, "last": b, "start": place[a][0], "end": place[b][1]} for a, b in merged]
        return len(words), hits, sum(b - a + 1 for a, b in merged), sorted(items)

    return scan


def _windows(benchmark: DataFrame) -> DataFrame:
    cut = common.text_udf(lambda: lambda text: (sorted(windows_of(text)),), "windows array<string>")
    each = benchmark.select(F.col("item_id").cast("long").alias("item"), F.explode(cut("text")["windows"]).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def scan_column(text: str | Column, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Column:
    """A struct column (FOUND) of what the benchmark's windows hit in `text`.

    n_words: words of the text; hits: maximal runs of hit words, as word numbers (`last` included)
    and as code points of the original text (`end` excluded); n_hit: hit words; items: the ids whose
    windows occur. A null or empty text, and any text beside an empty benchmark, has no hits. An item
    with a null id marks words but is not listed.
    """
    windows = common.written(_windows(benchmark), "windows")
    total = windows.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    column = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).orderBy("window") if blocks > 1 else windows
        held = benchmark.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in part.toLocalIterator()])
        column = _scan(held)(text) if column is None else _rescan(held)(text, column)
    return column


def _scan(held):
    def make():
        return scanner(automaton(held.value))

    return common.text_udf(make, FOUND)


def _rescan(held):
    kind = common.struct_of(FOUND)

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scan = scanner(automaton(held.value))
        for texts, before in batches:
            rows = [dict(zip(kind.fieldNames(), scan(t, b))) for t, b in zip(texts.to_pylist(), before.to_pylist())]
            yield pa.array(rows, type=to_arrow_type(kind))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_hit: int = 0) -> DataFrame:
    """The rows of `docs` with at most `max_hit` hit words; all columns stay as they are."""
    return docs.where(scan_column(F.col(text), benchmark)["n_hit"] <= max_hit)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words hit by benchmark windows, and the items they come from."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = docs.select("doc_id", scan_column(F.col("text"), benchmark).alias("f"))
    ids = F.array_sort(F.transform("f.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", F.col("f.n_words"), F.col("f.n_hit"), F.size("f.items").cast("long").alias("n_items"),
        common.lines_sha256(ids).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) t(p) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
