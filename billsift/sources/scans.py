"""Scans of semi-structured bodies: JSON, JSON inside HTML, rows by pattern, links."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import controls, urls
from ..functions.binding import bound

ROW_INPUT = 524_288
SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>"""
ANCHOR = r'\bhref="([^"]+)"'
#: The attributes of a link, and its text up to its end or the next link.
LINK = r"(?is)<a\b([^>]*)>((?:(?!</?a\b).){0,500})"
HEADING = r"(?is)<(?:h1|h2|h3|caption)\b[^>]*>(.{0,400}?)</(?:h1|h2|h3|caption)>"
HEADINGS, HEADING_CHARS, LABEL_CHARS = 12, 2000, 500
# The entities that are decoded before a second try, and the addresses of documents.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
DIRECT = r"\.pdf$|(?:^|/)(?:download|pdf)(?:/|$)"
HOSTED = r"(?i)^https://invoice\.stripe\.com/i/[^/?#]+/[^/?#]+(?:[?#]|$)"
LIKELY_LINKS = 100


def json_paths(path: str) -> list[str]:
    """The paths that a dotted path may stand for: a number is a place in an array, or else a key."""
    parts = [s for s in path.removeprefix("$").removeprefix(".").split(".") if s]
    ways = [[f"[{s}]", f"['{s}']"] if s.isdigit() else [f"['{s}']"] for s in parts]
    return ["$" + "".join(way) for way in product(*ways)]


def at_path(body: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of a variant; null if it is missing, null or of another kind."""
    return F.coalesce(*[F.try_variant_get(body, p, kind) for p in json_paths(path)])


def json_items(df: DataFrame, body: str, path: str) -> DataFrame:
    """`df` without `body`, with (pos, item): one row for each element of the array at `path`; no rows where there is no array or no JSON."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode(at_path(F.try_parse_json(body), path, "array<variant>")).alias("pos", "item"))


def embedded_json(html: Column) -> Column:
    """The JSON documents in a page's data scripts, as text, in order; scripts that do not parse, even decoded, are left out."""
    readable = lambda text: F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(decoded(text)).isNotNull(), decoded(text))
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), readable), lambda x: x.isNotNull())


def decoded(text: Column) -> Column:
    """Text with the five entities of scripts decoded."""
    for entity, mark in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def embedded_items(df: DataFrame, html: str, path: str) -> DataFrame:
    """`json_items` of the first embedded document of each row whose array at `path` is not empty."""
    rest = [c for c in df.columns if c != html]
    parsed = lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(decoded(x)))
    arrays = F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), lambda x: at_path(parsed(x), path, "array<variant>"))
    first = F.get(F.filter(arrays, lambda a: F.size(a) > 0), F.lit(0))
    return df.select(*rest, F.posexplode(first).alias("pos", "item"))


def regex_rows(df: DataFrame, html: str, pattern: str) -> DataFrame:
    """`df` without `html`, with pos and a column for each named group of `pattern`: one row for each match.

    A body of over ROW_INPUT characters is an error.
    """
    groups = re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern)).groupindex
    bare = re.sub(r"\(\?P?<(\w+)>", "(", pattern)
    rest = [c for c in df.columns if c != html]
    text = F.when(F.length(html) <= ROW_INPUT, F.col(html)).when(F.col(html).isNotNull(), F.raise_error(F.lit(f"a body of over {ROW_INPUT} characters")))
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(bare), F.lit(i)).alias(g) for g, i in groups.items()])
    return df.select(*rest, F.posexplode(zipped).alias("pos", "_row")).select(*rest, "pos", "_row.*")


def anchors(html: Column) -> Column:
    """All double-quoted link targets, in order."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


def title_of(html: Column) -> Column:
    """The page's title, white space made plain, 160 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 160)


def without_raw_text(html: Column) -> Column:
    """The page without its scripts and styles; a `>` inside a quoted attribute does not end a tag."""
    return F.regexp_replace(html, r"""(?is)<(script|style)\b(?:"[^"]*"|'[^']*'|[^"'>])*>.*?</\1\s*>""", "")


def absolute(url: Column, base: Column) -> Column:
    """A link as seen from the page at `base`, with its dot segments followed."""
    return bound(url, lambda u: bound(_full(u, base), _followed))


def _full(url: Column, base: Column) -> Column:
    folder = F.regexp_replace(F.concat(urls.origin_of(base), urls.path_of(base)), r"[^/]*\z", "")
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(
            url.startswith("//"), F.concat(urls.scheme_of(base), F.lit(":"), url),
        ).when(url.startswith("/"), F.concat(urls.origin_of(base), url))
        .when(
            url.startswith("?"), F.concat(urls.origin_of(base), urls.path_of(base), url),
        ).when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url)).otherwise(F.concat(folder, url))
    )


def _followed(full: Column) -> Column:
    """An address with its dot segments followed."""
    head = F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(full, r"(?s)^[^?#]*(.*)$", 1)
    return F.when(
        full.rlike(r"(?i)^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/(?:\.|%2e){1,2}(?:[/?#]|$)"), F.concat(head, urls.without_dots(urls.path_of(full)), tail),
    ).otherwise(full)


def page_names(html: Column) -> Column:
    """struct<title, application, site>: what a page calls itself in its title and in the two names of its head, 160 letters at most; null where it says nothing."""
    def meta(mark: str) -> Column:
        tag = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{mark})([^>]*)>""", 1)
        said = F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")])
        return F.nullif(F.substring(said, 1, 160), F.lit(""))

    named = (("application", r"""name\s*=\s*["']application-name["']"""), ("site", r"""property\s*=\s*["']og:site_name["']"""))
    return F.struct(F.nullif(title_of(html), F.lit("")).alias("title"), *[meta(mark).alias(n) for n, mark in named])


def document_links(df: DataFrame, html: str, base: str, cap: int = LIKELY_LINKS) -> DataFrame:
    """`df` without `html`, with (pos, link, label): the links of a page that are likely invoice documents, each once, the first `cap`.

    A likely link is https without user data and is not of an unrelated kind. It is marked as a download or is a direct document,
    and has an invoice context: in the page's title, headings or captions, or in its own address, attributes or label. A hosted invoice page
    needs neither. Whether the page's own route sounds like invoices does not count.
    """
    rest = [c for c in df.columns if c != html]
    clean = F.regexp_replace(without_raw_text(F.col(html)), "(?i)&nbsp;", " ")
    bare = lambda text: F.regexp_replace(text, "<[^>]*>", " ")
    heads = F.transform(F.slice(F.regexp_extract_all(clean, F.lit(HEADING), F.lit(1)), 1, HEADINGS), bare)
    about = F.concat_ws(" ", title_of(F.col(html)), F.substring(F.array_join(heads, " "), 1, HEADING_CHARS)).rlike(controls.DOCUMENT_CONTEXT)
    found = [F.regexp_extract_all(clean, F.lit(LINK), F.lit(k)) for k in (1, 2)]
    pairs = F.filter(
        F.transform(
            F.arrays_zip(found[0].alias("a"), found[1].alias("t")),
            lambda x: F.struct(
                x["a"].alias("marks"), F.regexp_extract(x["a"], r'(?i)\bhref="([^"]+)"', 1).alias("href"),
                F.when(F.length(x["t"]) < LABEL_CHARS, F.trim(F.regexp_replace(bare(x["t"]), r"\s+", " "))).otherwise("").alias("label"),
            ),
        ),
        lambda x: x["href"] != "",
    )
    full = F.transform(pairs, lambda x: F.struct(absolute(x["href"], F.col(base)).alias("link"), x["label"].alias("label"), x["marks"].alias("marks")))

    def likely(x: Column) -> Column:
        path = F.lower(urls.path_of(x["link"]))
        plain = x["link"].rlike("^https://[^/?#@]+(?:[/?#]|$)")
        unrelated = F.concat_ws(" ", F.element_at(F.split(path, "/"), -1), x["label"], x["marks"]).rlike(controls.UNRELATED)
        marked = x["marks"].rlike(r"(?i)(?:^|\s)download(?=[\s=>]|$)") | x["marks"].rlike(r'(?i)\b(?:aria-label|title)="[^"]*download[^"]*"')
        context = F.col("_about") | F.concat_ws(" ", path, x["marks"], x["label"]).rlike(controls.DOCUMENT_CONTEXT)
        return plain & ~unrelated & (x["link"].rlike(HOSTED) | (marked | path.rlike(DIRECT)) & context)

    rows = df.select(*rest, about.alias("_about"), full.alias("_all"))
    rows = rows.select(*rest, F.transform(F.filter("_all", likely), lambda x: F.struct(x["link"].alias("link"), x["label"].alias("label"))).alias("_links"))
    first = F.filter("_links", lambda x, i: F.array_position(F.transform("_links", lambda y: y["link"]), x["link"]) == i + 1)
    return rows.select(*rest, F.posexplode(F.slice(first, 1, cap)).alias("pos", "_x")).select(*rest, "pos", "_x.*")


def inline_pdf(url: Column, cap: int = 8 << 20) -> Column:
    """The bytes of a base64 data URL that are a PDF of at most `cap` bytes; null otherwise."""
    data = F.try_to_binary(F.regexp_extract(url, r"(?is)^data:application/pdf;base64,(.*)$", 1), F.lit("base64"))
    return F.when((F.length(data) <= cap) & is_pdf(data), data)


def is_pdf(data: Column) -> Column:
    return F.substring(data, 1, 4) == F.lit(b"%PDF")
