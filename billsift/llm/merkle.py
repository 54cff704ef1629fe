"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut at line ends into paragraphs, and paragraphs into leaves of
a few words that end where a sentence does. A section ends at an empty paragraph, or where a paragraph's own hash
says so (one in SECTION of them), so an edit does not shift the sections behind
it. Each node's hash is the hash of its children's, of 128 bits and of a kind of its own for each level. Equal roots mean
equal texts; where roots differ, the branches that differ lead to the edited paragraphs, and those alone are compared by leaves.

A fingerprint is text: the root (32 hex digits), then for each section `/`, its
hash, `:`, and its paragraphs, comma-separated, as their leaves' short hashes. It
grows with the text: about a quarter of its size.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# A leaf: at most four words, the marks that end a sentence, and the white space behind.
LEAF = re.compile(r"\s*(?:[^.!?\s]++\s*+){1,4}+[.!?]*\s*|\s*[.!?]++\s*|\s++")
SECTION = 8
RANGE_BYTES, MOST_RANGES = 16 << 20, 4096
SHORT = 6  # hex digits of a leaf or a section in the fingerprint


def _hashed(level: bytes):
    """The hash of a node of a level (leaf, paragraph, section or root) from its text or its children's hashes."""
    start = hashlib.blake2b(digest_size=16, person=level)

    def one(content: bytes) -> bytes:
        own = start.copy()
        own.update(content)
        return own.digest()

    return one


_leaf, _paragraph, _section, _root = map(_hashed, (b"leaf", b"paragraph", b"section", b"root"))


def fingerprint(text: str | None) -> str:
    """The tree of a text; null has that of the empty text."""
    sections: list[tuple[bytes, str]] = []
    hashes: list[bytes] = []
    shown: list[str] = []

    def close() -> None:
        sections.append((_section(b"".join(hashes)), ",".join(shown)))
        hashes.clear()
        shown.clear()

    for paragraph in (text or "").split("\n"):
        leaves = [_leaf(leaf.encode()) for leaf in LEAF.findall(paragraph)]
        own = _paragraph(b"".join(leaves))
        hashes.append(own)
        shown.append("".join([leaf[: SHORT // 2].hex() for leaf in leaves]))
        if not leaves or own[0] % SECTION == 0:
            close()
    if hashes:
        close()
    root = _root(b"".join(h for h, _ in sections)).hex()
    return root + "".join(f"/{h[: SHORT // 2].hex()}:{s}" for h, s in sections)


def root(fingerprint: str | Column) -> Column:
    """The root of a fingerprint column: equal for equal texts, and for no others but with the odds of a 128-bit hash."""
    return F.substring(fingerprint, 1, 32)


def _branches(fingerprint: str) -> list[tuple[str, list[str]]]:
    """The sections of a fingerprint, with their paragraphs."""
    return [(s[: SHORT + 1] + s, s[SHORT + 1 :].split(",")) for s in fingerprint.split("/")[1:]]


def _apart(own: list[tuple[str, list[str]]], other: list[tuple[str, list[str]]]) -> tuple[int, list[tuple[int, str]]]:
    """How many leaves of `own` stand in branches that `other` has, and the (number, leaves) of the paragraphs that it lacks.

    Sections that both have are skipped whole, as often as both have them; so are then paragraphs of the sections left.
    """
    sections = Counter(h for h, _ in other)
    left = Counter(h for h, _ in own) & sections
    spare: Counter = Counter()
    rest = left.copy()
    for h, paragraphs in other:
        if rest[h] > 0:
            rest[h] -= 1
        else:
            spare.update(paragraphs)
    same, at, out = 0, 0, []
    for h, paragraphs in own:
        if left[h] > 0:
            left[h] -= 1
            same += sum(map(len, paragraphs)) // SHORT
        else:
            for i, p in enumerate(paragraphs):
                if spare[p] > 0:
                    spare[p] -= 1
                    same += len(p) // SHORT
                else:
                    out.append((at + i, p))
        at += len(paragraphs)
    return same, out


def _leaves(paragraphs: list[tuple[int, str]]) -> Counter:
    return Counter(p[i : i + SHORT] for _, p in paragraphs for i in range(0, len(p), SHORT))


def compared(a: str, b: str) -> tuple[float, list[int], list[int]]:
    """The likeness of two fingerprints, and the numbers of the paragraphs of `a` that `b` lacks, and of `b` that `a` lacks.

    The trees are walked from the root: equal branches are shared whole, and only the leaves of paragraphs that differ are
    compared. The likeness is twice the shared leaves over all leaves of both: 1 for equal roots, else below 1.
    """
    if a[:32] == b[:32]:
        return 1.0, [], []
    x, y = _branches(a), _branches(b)
    (same, mine), (_, yours) = _apart(x, y), _apart(y, x)
    own, other = _leaves(mine), _leaves(yours)
    total = 2 * same + own.total() + other.total()
    shared = same + (own & other).total()
    return min(2 * shared / total, 1 - 1e-9) if total else 0.0, [i for i, _ in mine], [i for i, _ in yours]


def likeness(a: str, b: str) -> float:
    return compared(a, b)[0]


def differing(a: str, b: str) -> tuple[list[int], list[int]]:
    """The numbers of the paragraphs of `a` that `b` lacks, and of `b` that `a` lacks."""
    return compared(a, b)[1:]


def ranges(numbers: list[int]) -> str:
    """Rising numbers as comma-joined runs: 1-3,7."""
    out: list[list[int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(f"{a}-{b}" if b > a else str(a) for a, b in out)


def fingerprint_column(text: str | Column) -> Column:
    return common.text_udf(lambda: lambda text: (fingerprint(text),), "f string")(text)["f"]


def beside_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, late, own, id, text), sorted so that within a bucket each own row is followed by the next one in descending id.

    Rows are dealt by ranges of ids, of some RANGE_BYTES of text each (more if that were over MOST_RANGES; a range is sorted by Spark and streamed, never held); the first row of a range is also dealt to the range
    before it, and the first of all to the last range (`own` is false for these; `late` puts the latter behind the others).
    So each text moves once, or twice for one row a range. Rows with equal ids follow each other by text, and null ids come
    last; ids are meant to be unique: all rows of one id (and all with none) are in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES), MOST_RANGES)
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    found = rows.agg(F.percentile_approx("id", cuts, F.lit(100 * buckets)).alias("q")).first()["q"] if buckets > 1 else []
    bounds = sorted(set(found or []))  # an id a range
    # a row's range is the number of bounds below its id; null ids come before all others
    below = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col("id"))) if bounds else F.lit(0)
    dealt = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(0)).otherwise(below + 1))
    first = dealt.groupBy("bucket").agg(F.max("id").alias("first"))
    met = sorted((r["bucket"], r["first"]) for r in first.collect())  # a row a range
    also = [
        (b, value, met[i + 1][0], False) for i, (b, value) in enumerate(met) if i + 1 < len(met)
    ] + [(met[-1][0], met[-1][1], met[0][0], True) for _ in met[:1]]
    heads = F.broadcast(spark.createDataFrame(also, "_of int, _first long, _to int, _late boolean"))
    met_heads = dealt.join(heads, (F.col("bucket") == F.col("_of")) & F.col("id").eqNullSafe(F.col("_first")), "left")
    at = lambda bucket, late, own: F.struct(bucket.alias("bucket"), late.alias("late"), F.lit(own).alias("own"))
    here = at(F.col("bucket"), F.lit(False), True)
    there = F.when(F.col("_of").isNull(), F.array(here)).otherwise(F.array(here, at(F.col("_to"), F.col("_late"), False)))
    out = met_heads.select(F.explode(there).alias("at"), "id", "text").select("at.*", "id", "text")
    return out.repartitionById(len(bounds) + 2, F.col("bucket")).sortWithinPartitions("bucket", "late", F.col("id").desc_nulls_last(), "text")


def edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs).

    `edited_paragraphs` has the numbers of the paragraphs that the edited text lacks, from the branches that differ.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next row's
    text in descending id; the last row is followed by the first, so a single row by itself. Null texts are empty.
    """

    def make():
        held: list = []  # the row that waits for its next: bucket, own, id, text, fingerprint

        def each(batch):
            out: dict[str, list] = {
                c: [] for c in ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs")
            }
            for bucket, own, i, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "own", "id", "text"))):
                mark = fingerprint(value)
                if held and held[0] == bucket and held[1]:
                    _, _, k, before, known = held
                    n = len(before)
                    edited = before[: n - n // 2] + value[: n // 2]
                    changed = fingerprint(edited)
                    near, lost, _ = compared(known, changed)
                    row = (k, n, hashlib.sha256(edited.encode()).hexdigest(), known, changed, near, likeness(known, mark), ranges(lost))
                    for column, x in zip(out.values(), row):
                        column.append(x)
                held[:] = [bucket, own, i, value, mark]
            yield out

        return each

    return common.map_arrow(
        beside_next(docs, id, text), make,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs string",
    ).withColumnRenamed("id", id)


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return edits(common.documents(spark, sf_dir).select("doc_id", "text"))
