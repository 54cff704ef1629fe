"""Recipes: a closed description of a listing, checked on the driver and compiled to one DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transforms, urls
from ..sources import scans

FIELDS = ("id", "issuedAt", "total", "currency", "documentUrl", "documentRef", "status")
TRANSFORMS = ("divide", "date", "regex", "template", "replace", "trim", "upper", "lower")
MAX_TRANSFORMS, MAX_QUANTIFIER, MAX_PATTERN, MAX_ROW_PATTERN = 8, 100, 200, 2000


class RecipeError(ValueError):
    """A recipe outside of the closed schema."""


@dataclass(frozen=True)
class Extract:
    path: str
    transforms: Sequence[Mapping] = ()


@dataclass(frozen=True)
class Recipe:
    vendor: str
    kind: str  # json, embedded or rows
    items: str = "$"  # path of the array, or the pattern of rows
    map: Mapping[str, Extract] = field(default_factory=dict)


# What opens a group; an escape, a class, a count or a literal; and marks for what was read.
_OPEN = re.compile(r"\(\?(?::|P?<[A-Za-z_]\w*>)")
_PART = re.compile(r"(?P<atom>\\.|\[(?:\\.|[^\]\\])*\])|\{(?P<low>\d+)(?P<comma>,?)(?P<high>\d*)\}|[^()*+?|]", re.DOTALL)
_PLAIN, _VARIES, _TIMES = "\0", "\1", "\2"
_INNERMOST, _CHOICE, _ENDLESS = re.compile(r"\(([^()]*)\)"), re.compile(rf"[*+?|{_VARIES}{_TIMES}]"), re.compile(rf"{_VARIES}[*+]")


def _reduced(part: re.Match) -> str:
    """The mark of a part of a pattern; a count without an end is a plus."""
    if part["low"] is None:
        return _PLAIN
    if part["comma"] and not part["high"]:
        return "+"
    if int(part["high"] or part["low"]) > MAX_QUANTIFIER:
        raise RecipeError(f"a quantifier is over {MAX_QUANTIFIER}")
    return _TIMES


def check_pattern(pattern: str, most: int = MAX_PATTERN) -> None:
    """Raises RecipeError on a pattern that may take more than linear time, or is over `most` letters.

    Refused are back references, lookaround, a quantifier over MAX_QUANTIFIER, and an endless quantifier on a group that can
    match in more than one way: one that has a quantifier or a choice in it, at any depth. Groups are read from the innermost on.
    """
    if not 0 < len(pattern) <= most:
        raise RecipeError(f"a pattern has 1 to {most} letters")
    try:
        re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern))
    except re.error as e:
        raise RecipeError(f"no pattern: {e}") from None
    if re.search(r"\\[1-9]|\\k<|\(\?(?:=|!|<=|<!)", pattern):
        raise RecipeError("back references and lookaround are not allowed")
    left = _PART.sub(_reduced, _OPEN.sub("(", pattern))
    while (read := _INNERMOST.sub(lambda m: _VARIES if _CHOICE.search(m[1]) else _PLAIN, left)) != left:
        left = read
        if _ENDLESS.search(left):
            raise RecipeError("an endless quantifier on a group that varies is not allowed")


def check(recipe: Recipe) -> Recipe:
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", recipe.vendor):
        raise RecipeError("a vendor id is in kebab case")
    if recipe.kind not in ("json", "embedded", "rows"):
        raise RecipeError(f"unknown kind {recipe.kind}")
    if recipe.kind == "rows":
        check_pattern(recipe.items, MAX_ROW_PATTERN)
    if "id" not in recipe.map or set(recipe.map) - set(FIELDS):
        raise RecipeError(f"fields are id and any of {', '.join(FIELDS[1:])}")
    for one in recipe.map.values():
        if len(one.transforms) > MAX_TRANSFORMS:
            raise RecipeError(f"over {MAX_TRANSFORMS} transforms")
        for step in one.transforms:
            if step.get("kind") not in TRANSFORMS:
                raise RecipeError(f"unknown transform {step.get('kind')}")
            if "pattern" in step:
                check_pattern(step["pattern"])
    return recipe


def refs(recipe: Recipe, bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(refs, quarantine) of a table of bodies: rows with an id, and rows without one and the cause.

    Columns of `bodies` but `body` are kept; pos is the item's place in its listing.
    """
    check(recipe)
    keep = [c for c in bodies.columns if c != body]
    if recipe.kind == "rows":
        items = scans.regex_rows(bodies, body, recipe.items)
        value = lambda e: F.nullif(F.col(e.path), F.lit(""))
    else:
        items = (scans.json_items if recipe.kind == "json" else scans.embedded_items)(bodies, body, recipe.items)
        value = lambda e: scans.at_path(F.col("item"), e.path)
    fields = {name: transforms.applied(value(e), e.transforms) for name, e in recipe.map.items()}
    out = items.select(*keep, "pos", F.lit(recipe.vendor).alias("vendor"), *[v.alias(n) for n, v in fields.items()])
    blank = F.coalesce(F.trim("id"), F.lit("")) == ""
    return out.where(~blank), out.where(blank).withColumn("cause", F.lit("schema_invalid"))


def predicate(tree: Mapping, status: Column, body: Column) -> Column:
    """A predicate tree as a condition: statusIn, jsonPath (exists, then equals, then presence), and, or."""
    kind = tree["kind"]
    if kind in ("and", "or"):
        parts = [predicate(t, status, body) for t in tree["of"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "and" else out | p
        return out
    if kind == "statusIn":
        return F.coalesce(status.isin(*tree["values"]), F.lit(False))
    if kind == "jsonPath":
        found = scans.at_path(body, tree["path"])
        if "exists" in tree:
            return found.isNotNull() if tree["exists"] else found.isNull()
        if "equals" in tree:
            want = tree["equals"]
            same = F.coalesce(found == F.lit(str(want).lower() if isinstance(want, bool) else str(want)), F.lit(False))
            kinds = [F.schema_of_variant(F.coalesce(*[F.try_variant_get(body, p, "variant") for p in scans.json_paths(tree["path"])]))]
            text = F.coalesce(kinds[0] == "STRING", F.lit(False))
            return same & (text if isinstance(want, str) else ~text)
        return found.isNotNull()
    raise RecipeError(f"unknown predicate {kind}")


def same_origin(url: Column, request: Column) -> Column:
    """A pagination URL without its hash if it is https and of the request's origin; null otherwise."""
    full = F.regexp_replace(scans.absolute(url, request), "#.*$", "")
    return F.when((urls.scheme_of(full) == "https") & (urls.origin_of(full) == urls.origin_of(request)) & ~full.rlike("^[^/]*//[^/?#]*@"), full)
