"""What a person reads: names, days, counts, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file name that says nothing: one that was made up for a document without a number.
GENERIC_NAME = r"(?i)(?:^|[-_])unknown(?:[-_]|$)|document-[a-f0-9]{12,}"
RECENT_MS = 60_000


def title_case(id: Column) -> Column:
    """An id in kebab case as words that begin with a capital; digits keep their hyphen."""
    parts = F.split(id, "-(?=[a-z])", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), " ")


def ordinal_day(day: Column) -> Column:
    """A day of the month as an English ordinal."""
    last = day % 10
    suffix = F.when((day % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), suffix)


def count_label(visible: Column, total: Column) -> Column:
    """How many invoices are shown, and of how many."""
    return F.when(
        visible == total, F.concat(total.cast("string"), F.when(total == 1, " invoice").otherwise(" invoices")),
    ).otherwise(F.concat_ws(" of ", visible.cast("string"), total.cast("string")))


def invoice_label(number: Column, filename: Column) -> Column:
    """An invoice's number, else its file's name unless that says nothing, else `Invoice`."""
    name = F.trim(F.regexp_replace(filename, r"(?i)\.pdf\z", ""))
    return F.coalesce(F.nullif(number, F.lit("")), F.when((name != "") & ~name.rlike(GENERIC_NAME), name), F.lit("Invoice"))


def file_name(vendor: Column, issued: Column, id: Column) -> Column:
    """The name that a document gets where its recipe names none; a missing date is `unknown`."""
    return F.concat(vendor, F.lit("-"), F.coalesce(issued, F.lit("unknown")), F.lit("-"), id, F.lit(".pdf"))


def is_recent(collected_ms: Column, now_ms: Column) -> Column:
    """Whether something was collected within the last minute."""
    return F.coalesce(collected_ms.between(now_ms - RECENT_MS, now_ms), F.lit(False))
