"""Canonical bytes of PDF documents, so that a document generated anew keeps its content key."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

MAX_BYTES = 16 << 20
# What varies between two copies of one PDF, and where its streams begin and end.
VOLATILE = (
    (re.compile(rb"/(CreationDate|ModDate)[\s\xa0]*\(D:[^)\r\n]{4,64}\)"), rb"/\1 (D:VOLATILE)"),
    (re.compile(rb"/ID[\s\xa0]*\[[\s\xa0]*<[0-9A-Fa-f]{16,128}>[\s\xa0]*<[0-9A-Fa-f]{16,128}>[\s\xa0]*\]"), b"/ID [<VOLATILE> <VOLATILE>]"),
    (re.compile(rb"/URI[\s\xa0]*\(https://invoice\.stripe\.com/i/[^)\r\n]{1,2048}\)"), b"/URI (https://invoice.stripe.com/i/VOLATILE)"),
)
STREAM, STREAM_END = re.compile(rb"(?:\A|[\r\n])stream[ \t]*(?:\r\n|\n|\r)"), re.compile(rb"(?:\r\n|\n|\r)endstream(?![A-Za-z0-9_])")


def canonical(data: bytes) -> bytes:
    """The bytes with dates, file ids and hosted links blanked outside of streams; as they are if over MAX_BYTES, no PDF, or if a stream has no end."""
    if len(data) > MAX_BYTES or not data.startswith(b"%PDF-"):
        return data
    starts, ends, at = [], [], 0
    while start := STREAM.search(data, at):
        if not (end := STREAM_END.search(data, start.end())):
            return data
        starts.append(start.end())
        ends.append(end.start())
        at = end.start()
    outside = lambda m: not (k := bisect.bisect_left(starts, m.end())) or ends[k - 1] <= m.start()
    found = sorted((m.start(), m.end(), m.expand(by)) for pattern, by in VOLATILE for m in pattern.finditer(data) if outside(m))
    out, at = [], 0
    for start, end, by in found:
        if start >= at:
            out += [data[at:start], by]
            at = end
    return b"".join([*out, data[at:]]) if found else data


def canonical_pdf(spark: SparkSession, content: str | Column) -> Column:
    """`canonical` of a column of bytes; null stays null."""
    ship(spark)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else canonical(x) for x in batch.to_pylist()], type=pa.binary())

    return run(content)
