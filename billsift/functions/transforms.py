"""Scalar transforms of the extraction language, as Column builders.

A missing or null input stays null through every transform.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

REGEX_INPUT = 16_384
# The forms of dates in their order, each with a pattern that all its texts match: a text that is of no form is not parsed in vain.
_MONTH = r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
FORMATS = (
    (r"[Tt].*(?:[Zz]|[+-]\d\d:?\d\d)", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"), ("[Tt]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]"), (":", "yyyy-MM-dd HH:mm:ss"),
    ("^[^:]*-[^:]*$", "yyyy-MM-dd"), ("/", "yyyy/MM/dd"), (_MONTH, "MMM d, yyyy"), (_MONTH, "MMMM d, yyyy"), (_MONTH, "d MMM yyyy"), (_MONTH, "d MMMM yyyy"),
    (_MONTH, "d MMM yyyy HH:mm:ss z"),
)
#: What a browser's trim() takes off: ASCII and Unicode white space, and the byte-order mark.
BLANK = r"[\s   -     　﻿]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def divided(c: Column, by: int) -> Column:
    """A number as text with two decimals, exactly; text that is no number stays as it is."""
    number = c.cast("string").try_cast("decimal(28,6)")
    return F.when(number.isNull(), c.cast("string")).otherwise(F.round(number / F.lit(by).cast("decimal(10,0)"), 2).cast("decimal(28,2)").cast("string"))


def dated(c: Column, epoch: str | None = None) -> Column:
    """ISO date in UTC of epoch seconds (`s`), milliseconds (`ms`), or of ISO, month-name or mail-header text; what is no date stays as it is."""
    text = c.cast("string")
    if epoch:
        at = F.timestamp_seconds(text.try_cast("bigint")) if epoch == "s" else F.timestamp_millis(text.try_cast("bigint"))
    else:
        bare = F.regexp_replace(text, "^[A-Za-z]{3,9}, (?=[0-9])", "")  # the weekday of a mail header
        at = bound(bare, lambda b: F.coalesce(*[F.when(b.rlike(shape), F.try_to_timestamp(b, F.lit(f))) for shape, f in FORMATS]))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), text)


def matched(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null without a match, or for an input over REGEX_INPUT characters."""
    return F.when((F.length(c) <= REGEX_INPUT) & c.rlike(pattern), F.regexp_extract(c, pattern, group))


def replaced_first(c: Column, pattern: str, by: str) -> Column:
    """The first match replaced; `$1` and the like name groups of the pattern."""
    inner = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(c, rf"(?s)\A(.*?)(?:{pattern})(.*)\z", f"$1{inner}${re.compile(pattern).groups + 2}")


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """`{name}` filled in; a null value is an error, an unknown name one at once."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece not in values:
            raise KeyError(f"the template names {piece}, which is not given")
        else:
            parts.append(F.coalesce(values[piece].cast("string"), F.raise_error(F.lit(f"template value {piece} is missing"))))
    return F.concat(*parts)


def truthy(c: Column) -> Column:
    """Whether a continuation flag says that more follows."""
    return ~F.lower(trimmed(F.coalesce(c.cast("string"), F.lit("")))).isin("", "false", "no", "0", "null", "off")


def applied(c: Column, steps: Sequence[Mapping]) -> Column:
    """Up to eight transforms from left to right."""
    if len(steps) > 8:
        raise ValueError("at most eight transforms")
    for step in steps:
        kind = step["kind"]
        if kind == "divide":
            c = divided(c, step["by"])
        elif kind == "date":
            c = dated(c, step.get("epoch"))
        elif kind == "regex":
            c = matched(c, step["pattern"], step.get("group", 0))
        elif kind == "replace":
            c = replaced_first(c, step["pattern"], step["with"])
        elif kind == "template":
            before, after = step["text"].split("{value}")
            c = F.concat(F.lit(before), c, F.lit(after))
        elif kind in ("trim", "upper", "lower"):
            c = {"trim": trimmed, "upper": F.upper, "lower": F.lower}[kind](c)
        else:
            raise ValueError(f"unknown transform {kind}")
    return c
