"""Recipes drafted from captured sessions: the list that looks most like invoices, its fields, how it goes on, and what it needs to be asked for again.

Every step is an aggregate over the fields of all sessions; a draft is a row. Fields and the lists chosen of them are written
between steps, so drafts decode each body once and no step's plan holds those before it. `replayed` runs drafts over the same bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exploration, transforms, urls
from ..functions.binding import bound
from ..sources import scans, walks
from . import actions, ranking, tracing
from .numbering import written

LEAST = 0.5
KEYS = ["session", "pos", "script"]
# What names of fields say.
MONEY, DATE = r"(?i)amount|total|price|sum|due|charge|cost|gross|net", r"(?i)date|created|issued|_ts$|_at$|timestamp|period"
ID, CURRENCY = r"(?i)^id$|_id$|invoice.*(?:id|no|number)|^number$|reference", r"(?i)^currency$|^curr$|currency_code"
DOCUMENT = r"(?i)pdf|hosted|download|receipt|(?:invoice|document|file|attachment|statement)[_-]?(?:url|uri|link|href)"
PDF_VALUE, HOSTED = r"(?i)/pdf(?:\?|$)|\.pdf(?:\?|$)", r"invoice\.stripe\.com/i/"
DAY = r"(?i)^\s*(?:\d{4}-\d{2}(?:-\d{2})?(?:[T ].*)?|\d{4}/\d{1,2}/\d{1,2}.*|\d{1,2}/\d{1,2}/\d{4}.*|(?:\w{3,9},?\s+)?(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,4}.*)$"
SECONDS = 1e11  # a number below is seconds, not milliseconds


def _number(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c).try_cast("double"))


def _is_number(kind: Column, value: Column) -> Column:
    return F.coalesce(
        kind.isin("number", "string") & _number(value).isNotNull() & (F.abs(_number(value)) < float("inf")) & ~F.isnan(_number(value)), F.lit(False),
    )


def _is_date(kind: Column, value: Column) -> Column:
    return F.coalesce((kind == "number") & (_number(value) > 1e8) | (kind == "string") & value.rlike(DAY), F.lit(False))


def _is_address(kind: Column, value: Column) -> Column:
    return F.coalesce((kind == "string") & value.rlike("^(?:https?://|/(?!/))"), F.lit(False))


def fields(entries: DataFrame) -> DataFrame:
    """The fields of all lists in the sessions' answers: KEYS, source (`json`, `html`), and what `walks.listed_fields` gives.

    `entries` has session, pos (unique in it), status, content_type and response_body. Pages give their data scripts, numbered by `script`.
    """
    good = entries.where(F.col("status").between(200, 299) & F.col("response_body").isNotNull())
    page = F.coalesce(F.col("content_type"), F.lit("")).contains("html")
    bodies = F.when(page, scans.embedded_json(F.col("response_body"))).otherwise(F.array("response_body"))
    roots = good.select("session", "pos", F.when(page, "html").otherwise("json").alias("source"), F.posexplode(bodies).alias("script", "_body"))
    decoded = roots.withColumn(
        "_body", F.when((F.col("source") == "html") & F.try_parse_json("_body").isNull(), scans.decoded(F.col("_body"))).otherwise(F.col("_body")),
    )
    return walks.listed_fields(decoded, "_body")


def invoice_lists(found: DataFrame) -> DataFrame:
    """(session, pos, script, list, source, prefix, n_items, score): of each session the list of which most objects look like invoices, at least half.

    One has a date, and an amount or an id and a document's address. Answers go before pages, longer lists before shorter ones, then first come.
    """
    key, kind, value = F.col("key"), F.col("kind"), F.col("value")
    on = lambda what: F.max(F.coalesce(what, F.lit(False)).cast("int"))
    document = _is_address(kind, value) & (value.rlike(PDF_VALUE) | key.rlike(DOCUMENT))
    lists = [*KEYS, "list", "turn", "source", "prefix", "n_items"]
    items = found.groupBy(*lists, "item").agg(
        on(key.rlike(DATE) & _is_date(kind, value)).alias("d"), on(key.rlike(MONEY) & _is_number(kind, value)).alias("m"),
        on(key.rlike(ID) & kind.isin("string", "number")).alias("i"), on(document).alias("u"),
    )
    scored = items.groupBy(*lists).agg(
        (F.sum(F.col("d") * F.greatest(F.col("m"), F.col("i") * F.col("u"))) / F.col("n_items")).alias("score")
    ).where(F.col("score") >= LEAST)
    rank = F.struct((-F.col("score")).alias("a"), (F.col("source") == "html").alias("b"), (-F.col("n_items")).alias("c"), "pos", "script", "turn")
    best = scored.groupBy("session").agg(F.min_by(F.struct("pos", "script", "list", "source", "prefix", "n_items", "score"), rank).alias("_b"))
    return best.select("session", "_b.*")


def field_maps(found: DataFrame, lists: DataFrame) -> DataFrame:
    """`lists` with what the fields of each list's first object stand for: id, identity (`explicit_field`, `date_fallback`), date, epoch, total, minor, currency, upper, document, hosted; none without an id or a date."""
    key, kind, value = F.col("key"), F.col("kind"), F.col("value")
    first = lambda what, c="key": F.min_by(F.when(what, F.col(c)), F.when(what, F.col("place")))
    dated, money = key.rlike(DATE) & _is_date(kind, value), key.rlike(MONEY) & _is_number(kind, value)
    is_pdf, is_named = _is_address(kind, value) & value.rlike(PDF_VALUE), _is_address(kind, value) & key.rlike(DOCUMENT)
    number = _number(value)
    sample = found.where("item = 0").join(lists.select("session", "pos", "script", "list"), ["session", "pos", "script", "list"], "left_semi")
    told = sample.groupBy("session").agg(
        first(key.rlike(ID)).alias("_id"), first(dated).alias("date"), F.min_by(
            F.when(dated, F.when(kind == "number", F.when(number < SECONDS, "s").otherwise("ms"))), F.when(dated, F.col("place")),
        ).alias("epoch"),
        first(money).alias("total"), F.min_by(F.when(money, number == F.floor(number)), F.when(money, F.col("place"))).alias("minor"),
        first(key.rlike(CURRENCY)).alias("currency"), F.min_by(
            F.when(key.rlike(CURRENCY), (kind == "string") & (value == F.lower(value))), F.when(key.rlike(CURRENCY), F.col("place")),
        ).alias("upper"),
        F.coalesce(first(is_pdf), first(is_named)).alias("document"), F.coalesce(first(is_pdf, "value"), first(is_named, "value")).alias("_link"),
    ).withColumnRenamed("session", "_s")
    out = lists.join(told, F.col("session").eqNullSafe(F.col("_s"))).withColumns(
        {
            "id": F.coalesce("_id", "date"), "identity": F.when(F.col("_id").isNotNull(), "explicit_field").otherwise("date_fallback"),
            "hosted": F.coalesce(F.col("_link").rlike(HOSTED), F.lit(False)),
        }
    )
    return out.where("id IS NOT NULL").drop("_s", "_id")


def _templated(url: Column, kind: Column) -> Column:
    """The address with the first query key that its kind of paging uses set to that kind's variable."""
    pairs = F.split(urls.query_of(url), "&")
    key = lambda kv: F.regexp_extract(kv, "^([^=]*)", 1)
    uses = lambda kv: F.when(
        kind == "cursor", key(kv).isin(*tracing.CURSOR_QUERY),
    ).when(kind == "offset", F.lower(key(kv)) == "offset").when(kind == "page", F.lower(key(kv)).isin("page", "p")).otherwise(False)
    name = key(F.get(F.filter(pairs, uses), F.lit(0)))
    told = F.array_join(F.transform(pairs, lambda kv: F.when(key(kv) == name, F.concat(name, F.lit("={"), kind, F.lit("}"))).otherwise(kv)), "&")
    return F.when(name.isNotNull() & kind.isNotNull(), F.concat(F.regexp_extract(url, r"^([^?]*)", 1), F.lit("?"), told)).otherwise(url)


def drafts(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """A row for each session that has a list like invoices: which list, its fields, the request to ask for it again, how it goes on, where its ids come from, the login check, and how sure that is.

    `entries` has session, pos, url, method, status, content_type, request_body and response_body; `origins` session and origin. Ids in the listing's
    request that another answer gives become `{names}` (config). A session whose request keeps something redacted has no draft.
    """
    found = written(fields(entries), "fields")
    maps = written(field_maps(found, invoice_lists(found)), "maps")
    at = entries.select(F.col("session").alias("_s"), F.col("pos").alias("_p"), "url", "method", "request_body", "response_body")
    asked = maps.join(at, F.col("session").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p"))).drop("_s", "_p")
    paging = tracing.pagination(asked.where("source = 'json'"), ["session"], "url", "response_body").select(
        F.col("session").alias("_s"), F.col("kind").alias("paginate"), F.col("path").alias("cursor"), F.col("more").alias("has_more"), "page_size",
    )
    asked = asked.join(paging, F.col("session").eqNullSafe(F.col("_s")), "left").drop("_s", "response_body")
    traced = tracing.provenance(entries, asked.where("source = 'json'").select("session", "pos"))
    given = traced.groupBy(F.col("session").alias("_s")).agg(F.array_sort(F.collect_set(F.struct("config_id", "source", "path", "token"))).alias("_given"))
    probes = actions.auth_probe(
        entries.join(origins.withColumnRenamed("session", "_o"), F.col("session").eqNullSafe(F.col("_o"))), ["session"], "origin", "method", "status",
        "url", "pos",
    ).select(F.col("session").alias("_o"), "probe")
    rows = asked.join(given, F.col("session").eqNullSafe(F.col("_s")), "left").join(probes, F.col("session").eqNullSafe(F.col("_o")), "left")
    named = lambda c: F.aggregate(
        F.coalesce("_given", F.array().cast("array<struct<config_id:string,source:bigint,path:string,token:string>>")), c,
        lambda text, g: F.replace(text, g["token"], F.concat(F.lit("{"), g["config_id"], F.lit("}"))),
    )
    request = named(F.when(F.col("paginate").isNull() | (F.col("paginate") == "next-url"), F.col("url")).otherwise(_templated(F.col("url"), F.col("paginate"))))
    body = F.when(F.col("source") == "json", named(F.col("request_body")))
    field = lambda c: F.concat("prefix", c)
    out = rows.select(
        "session", "pos", "script", "source", F.col("list").alias("items"), F.col("n_items"), "prefix", field("id").alias("id"), "identity", field("date").alias("date"), "epoch", field("total").alias("total"), "minor", field("currency").alias("currency"), "upper", field("document").alias("document"), "hosted",
        request.alias("request"), body.alias("request_body"), "method", "paginate", "cursor", "has_more", "page_size", F.transform(
            F.coalesce("_given", F.array().cast("array<struct<config_id:string,source:bigint,path:string,token:string>>")),
            lambda g: F.struct(g["config_id"].alias("id"), g["source"].alias("source"), g["path"].alias("path")),
        ).alias("config"),
        "probe", ranking.confidence(F.col("n_items"), F.col("document").isNotNull(), F.col("probe").isNotNull()).alias("confidence"),
    )
    return out.where(~exploration.unbound_redaction(F.col("request")) & ~F.coalesce(exploration.unbound_redaction(F.col("request_body")), F.lit(False)))


def replayed(drafts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, quarantine): what drafts give of the answers that they were drafted from: session, item, id, issued_at, total, currency, document_url; and the items without an id.

    The fields are joined to their draft; no body is read twice. A blank id, and the words for no value, count as none.
    """
    mine = drafts.select(
        F.col("session").alias("_s"), F.col("pos").alias("_p"), F.col("script").alias("_n"), F.col("items").alias("_items"),
        *[F.regexp_replace(c, r"^(?:node|attributes)\.", "").alias(f"_{c}") for c in ("id", "date", "total", "currency", "document")], "epoch",
        "minor", "upper", "hosted", F.col("request").alias("_request"),
    )
    mine = written(mine, "drafts")
    same = F.col("session").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")) & (F.col("script") == F.col("_n")) & (F.col("list") == F.col("_items"))
    met = fields(entries).join(mine, same)
    value = lambda c: F.max(F.when(F.col("key") == F.col(f"_{c}"), F.col("value"))).alias(c)
    items = met.groupBy("session", "item", "epoch", "minor", "upper", "hosted", "_request").agg(*map(value, ("id", "date", "total", "currency", "document")))
    when = F.when(F.col("epoch").isNull(), transforms.dated(F.col("date"))).when(
        F.col("epoch") == "s", transforms.dated(F.col("date"), "s"),
    ).otherwise(transforms.dated(F.col("date"), "ms"))
    hosted = lambda link: F.regexp_replace(link, r"^https://invoice\.stripe\.com/i/([^/?#]+)/([^/?#]+)(\?.*)?$", r"https://pay.stripe.com/invoice/$1/$2/pdf$3")
    link = bound(scans.absolute(F.col("document"), F.col("_request")), lambda x: F.when(F.col("hosted"), hosted(x)).otherwise(x))
    out = items.select(
        "session", "item", F.trim("id").alias("id"), when.alias("issued_at"), F.when(
            F.col("minor"), transforms.divided(F.col("total"), 100),
        ).otherwise(F.col("total")).alias("total"),
        F.when(F.col("upper"), F.upper("currency")).otherwise(F.col("currency")).alias("currency"), link.alias("document_url"),
    )
    blank = F.coalesce(F.col("id").isin("", "undefined", "null"), F.lit(True))
    return out.where(~blank), out.where(blank).select("session", "item")


def compiled(drafts: DataFrame, links: DataFrame, controls: DataFrame) -> DataFrame:
    """(session, adapter, place, items, request, preview): the candidates of each session, in the order in which they are tried.

    Drafts of answers come first, then those of pages; a draft whose ids are dates is none, and no candidate keeps an inferred total, as whole
    numbers may be in either unit. Then direct links to documents (`links`: session, url, n_links), and only where there are none, controls
    (`controls`: session, url, n_controls, n_sections), whose count is at least one and at most 500, as that of links.
    """
    none = F.lit(None).cast("string")
    structured = drafts.where("identity <> 'date_fallback'").select(
        "session", F.when(F.col("source") == "json", "network-json").otherwise("embedded-json").alias("adapter"), "items", "request",
        F.col("n_items").cast("int").alias("preview"),
    )
    direct = links.where("n_links > 0").select(
        "session", F.lit("dom-links").alias("adapter"), none.alias("items"), F.col("url").alias("request"),
        F.least(F.lit(500), "n_links").cast("int").alias("preview"),
    )
    linked = direct.select(F.col("session").alias("_s"))
    said = controls.where("n_controls + n_sections > 0").join(linked, F.col("session").eqNullSafe(F.col("_s")), "left_anti")
    semantic = said.select(
        "session", F.lit("dom-actions").alias("adapter"), none.alias("items"), F.col("url").alias("request"),
        F.least(F.lit(500), F.greatest(F.lit(1), "n_controls")).cast("int").alias("preview"),
    )
    order = F.array(*map(F.lit, ("network-json", "embedded-json", "dom-links", "dom-actions")))
    found = structured.unionByName(direct).unionByName(semantic)
    return found.select("session", "adapter", F.array_position(order, F.col("adapter")).cast("int").alias("place"), "items", "request", "preview")
