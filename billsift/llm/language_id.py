"""Language identification by rank-order profiles.

Each language has a profile: its most frequent letter n-grams (one to three
letters, words padded by a blank on either side), in order of frequency. A
document's own most frequent n-grams are compared with every profile: the
out-of-place distance adds up how far each n-gram's rank is from its rank in
the profile, and the full depth for an n-gram that the profile lacks. The
language of least distance is predicted.

An n-gram is one whole number (three code points of 21 bits, a blank is zero),
so a text's n-grams are counted by a sort, without a memory of words. Texts are
read whole, some CHUNK letters at a time.

Profiles hold DEPTH n-grams a language, so their size has a bound whatever the
corpus: n-grams are counted over all training rows by Spark, and only the
profiles come to the driver. More than MAX_LANGS languages are an error.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEPTH = 300
MAX_LANGS = 1000
CHUNK = 1 << 18
#: A training task sends its counts on when it holds so many different n-grams.
HELD = 500_000
BITS = 21  # of a code point
PAIR = 1 << 62
UNKNOWN = "und"
#: The pipeline's least score: with less, a text has next to nothing in common with any profile.
LEAST_SCORE = 0.05


@cache
def letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, in order of their numbers, and how often each occurs. Upper case counts as lower."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters().take(code)
    # blanks between words are made single: a blank counts only behind a letter
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 0)[keep].astype(np.int64)
    if not len(code):
        return none
    code = np.concatenate([[0], code, [0] * (1 + int(code[-1] != 0))])
    parts = []
    for at in range(0, len(code), CHUNK):
        part = code[at : at + CHUNK + 2]
        first, second, third = part[:CHUNK], part[1 : CHUNK + 1], part[2:]
        two = (first[: len(second)] << BITS) | second
        three = (two[: len(third)] << BITS) | third
        # no n-gram is of blanks alone, and no three letters go over a blank; a pair is told from the others by its top bit
        every = np.concatenate([first[first > 0], two[two > 0] | PAIR, three[second[: len(third)] > 0]])
        every.sort()
        parts.append(runs(every, None))
    return merged(parts)


def runs(key: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted keys, and how often each occurs or the sum of its times."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.diff(np.append(new, len(key))) if times is None else np.add.reduceat(times, new)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of counts of n-grams."""
    if len(parts) == 1:
        return parts[0]
    key, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    return runs(key[order], times[order])


def shown(gram: int) -> str:
    """An n-gram's letters; `_` is the blank."""
    size = 2 if gram & PAIR else 3 if gram >> BITS else 1
    return "".join(chr(c) if (c := gram >> BITS * i & (1 << BITS) - 1) else "_" for i in reversed(range(size)))


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) of the rows whose language and text are not null, summed within tasks before the shuffle."""

    def make():
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for key, (grams, n) in held.items():
                yield {"lang": [key] * len(grams), "gram": grams, "n": n}
            held.clear()

        def each(batch):
            waiting: dict[str, list] = {}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = waiting.setdefault(key, [])
                own.append(ngrams_of(value))
                if len(own) >= 256:
                    waiting[key] = [merged(own)]
            for key, own in waiting.items():
                held[key] = merged([*own, *([held[key]] if key in held else [])])
            if sum(len(grams) for grams, _ in held.values()) > HELD:
                yield from flush()

        each.rest = flush
        return each

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return common.map_arrow(rows, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH) -> dict[str, list[int]]:
    """Language -> its `depth` most frequent n-grams, most frequent first (equal counts by the n-gram's number).

    Learnt from all rows whose language and text are not null; no such rows give no profiles.
    """
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = ngram_counts(docs, text, lang).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").limit(MAX_LANGS * depth + 1).toLocalIterator():
        out.setdefault(r["lang"], []).append(r["gram"])
    if len(out) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return out


class Identifier:
    """Predicts (language, score) of texts, one after the other."""

    def __init__(self, learnt: dict[str, list[int]], depth: int = DEPTH):
        self.langs, self.depth = sorted(learnt), depth
        entries = sorted((g, k, rank) for k, lang in enumerate(self.langs) for rank, g in enumerate(learnt[lang]))
        grams, self.lang, self.rank = (np.array(x, np.int64) for x in zip(*entries)) if entries else (np.zeros(0, np.int64) for _ in range(3))
        # the n-grams of all profiles, and where the entries of each begin
        self.known, start = np.unique(grams, return_index=True)
        self.start = np.append(start, len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """`und` and 0 for a text that is null or has no letter, or where nothing was learnt.

        An n-gram's rank is the number of n-grams that occur more often, so equal counts share a rank;
        those of rank below the depth count. The score is 1 less the distance's share of the largest
        possible one. Of languages at equal distance the first in alphabetical order is taken.
        """
        grams, times = ngrams_of(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        falling = np.sort(-times)
        rank = np.searchsorted(falling, -times, side="left")
        top = rank < self.depth
        grams, rank = grams[top], rank[top]
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        met = self.known[at] == grams
        at, own = at[met], rank[met]
        # each entry of a profile that the document has brings its distance down from the depth
        n = self.start[at + 1] - self.start[at]
        entry = common.ragged(self.start[at], n)
        nearer = self.depth - np.abs(self.rank[entry] - np.repeat(own, n))
        apart = self.depth * len(grams) - np.bincount(self.lang[entry], weights=nearer, minlength=len(self.langs))
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.depth * len(grams))


def predict_column(text: str | Column, learnt: dict[str, list[int]], spark: SparkSession, depth: int = DEPTH) -> Column:
    """A struct (lang, score) for each text; see Identifier.predict for what its values mean."""
    held = spark.sparkContext.broadcast(learnt)
    return common.text_udf(lambda: Identifier(held.value, depth).predict, "lang string, score double")(text)


def keep_identified(docs: DataFrame, learnt: dict[str, list[int]], text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows with a known language and at least the score `least`; all columns stay as they are.

    A null, empty or letterless text is of no known language; neither is any text where nothing was learnt.
    """
    found = predict_column(F.col(text), learnt, docs.sparkSession)
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] >= least))


def is_held_out(id: str = "doc_id") -> Column:
    return (F.crc32(F.col(id).cast("string")) % 4 == 2) & F.col(id).isNotNull()


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, from profiles of the documents that are not held out."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    learnt = profiles(docs.where(~is_held_out()))
    found = docs.select("doc_id", is_held_out().alias("held_out"), predict_column(F.col("text"), learnt, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
