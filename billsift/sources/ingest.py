"""What a page reports of itself, held within bounds: what is beyond them is dropped and counted, not trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, urls
from ..operators.ranking import within_budget

URL_CHARS, NAME_CHARS, HTML_CHARS, HOST_CHARS, TYPE_CHARS, BODY_CHARS, REQUEST_CHARS, LABEL_CHARS, CONTEXT_CHARS = 2048, 160, 750_000, 253, 256, 256_000, 65_536, 160, 240
HOSTS, RESOURCES, LINKS, ALL_BODIES, COUNT = 8, 80, 80, 768_000, 1000
BOUNDS = ("names", "html", "hosts", "resources", "bodies", "links", "counts")
EVIDENCE = (
    "origin string, url string, title string, application string, site string, html string, hosts array<string>, "
    "resources array<struct<url:string,status:int,content_type:string,body:string,method:string,request_body:string>>, links array<struct<url:string,label:string,context:string>>, counts map<string,int>"
)


def _long(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c) > most, F.lit(False))


def _counted(kept: Column, offered: Column) -> Column:
    return F.size(offered) - F.size(kept)


def bounded(evidence: DataFrame, expected: str, name: str = "evidence", resources: int = RESOURCES) -> tuple[DataFrame, Observation]:
    """(pages, observation): the pages of `evidence` (EVIDENCE and the origin `expected` of each) that are what was asked for, within bounds.

    A page of another origin, or whose address is not https or has user data, is left out. All that is over a bound is dropped: names
    over 160 letters, more than 8 hosts or one that is not public, resources of other origins or that do not fit, bodies that would bring all
    of a page's over 768,000 letters (later, shorter ones may fit), links that are no safe routes, counts over 1,000. `dropped` has how much
    by each bound, and the observation the sums over all pages and `refused`: Spark adds these up while the pages are read, without a second pass.
    A missing list or html counts as one drop; a missing name or count is none.
    """
    c = F.col
    none = lambda kind: F.array().cast(kind)
    kinds = dict(evidence.select("hosts", "resources", "links").dtypes)
    plain = (c("origin") == c(expected)) & ~_long(c("url"), URL_CHARS) & (urls.scheme_of(c("url")) == "https") & (urls.origin_of(c("url")) == c(expected)) & ~c("url").rlike("^[^/]*//[^/?#]*@")
    rows = evidence.withColumn("_ok", F.coalesce(plain, F.lit(False)))
    offered_hosts = F.coalesce("hosts", none(kinds["hosts"]))
    is_host = lambda h: F.coalesce(
        (F.length(h) <= HOST_CHARS) & policy.is_origin_pattern(F.concat(F.lit("https://"), h, F.lit("/*"))) & ~h.contains(":"), F.lit(False),
    )
    good_hosts = F.filter(F.slice(offered_hosts, 1, HOSTS), is_host)
    rows = rows.withColumns({"_hosts": F.array_distinct(good_hosts), "_no_hosts": _counted(good_hosts, offered_hosts) + c("hosts").isNull().cast("int")})

    offered = F.coalesce("resources", none(kinds["resources"]))
    own = lambda u: (urls.origin_of(u) == c(expected)) | F.exists(
        "_hosts", lambda h: urls.origin_of(u) == F.concat(F.lit("https://"), F.lower(h)),
    )
    fits = lambda r: F.coalesce(
        (F.length(r["url"]) <= URL_CHARS) & r["status"].between(0, 599) & (F.length(r["content_type"]) <= TYPE_CHARS) & (F.length(r["body"]) <= BODY_CHARS) & F.coalesce(
            r["method"].isin("GET", "POST"), F.lit(True),
        ) & ~_long(r["request_body"], REQUEST_CHARS)
        & (urls.scheme_of(r["url"]) == "https") & own(r["url"]) & ~r["url"].contains("#") & ~r["url"].rlike("^[^/]*//[^/?#]*@"),
        F.lit(False),
    )
    rows = rows.withColumn("_fit", F.filter(F.slice(offered, 1, resources), fits)).withColumn(
        "_within", within_budget(F.transform("_fit", lambda r: F.length(r["body"])), ALL_BODIES),
    )
    kept = F.filter("_fit", lambda r, i: F.get("_within", i))
    offered_links = F.coalesce("links", none(kinds["links"]))
    tidy = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    route = lambda x: F.when(
        (F.length(x["url"]) <= URL_CHARS) & ~_long(x["label"], LABEL_CHARS) & ~_long(x["context"], CONTEXT_CHARS) & (urls.origin_of(x["url"]) == c(expected)),
        urls.safe_route(x["url"]),
    )
    told = F.transform(
        F.slice(offered_links, 1, LINKS),
        lambda x: F.struct(route(x).alias("url"), tidy(x["label"]).alias("label"), tidy(x["context"]).alias("context")),
    )
    good_links = F.filter(told, lambda x: x["url"].isNotNull())
    short = lambda name: F.when(~_long(c(name), NAME_CHARS), c(name)).alias(name)
    counts = F.coalesce("counts", F.create_map().cast("map<string,int>"))
    is_count = lambda k, v: F.coalesce(v.between(0, COUNT), F.lit(False))
    lost = {
        "names": sum(
            (_long(c(n), NAME_CHARS).cast("int") for n in ("title", "application", "site")), F.lit(0),
        ), "html": (c("html").isNull() | _long(c("html"), HTML_CHARS)).cast("int"), "hosts": c("_no_hosts"),
        "resources": _counted(c("_fit"), offered) + c("resources").isNull().cast("int"), "bodies": _counted(kept, c("_fit")), "links": _counted(good_links, offered_links) + c("links").isNull().cast("int"),
        "counts": F.size(F.map_filter(counts, lambda k, v: ~is_count(k, v))),
    }
    rest = [x for x in evidence.columns if x not in {f.split()[0] for f in EVIDENCE.split(", ")}]
    out = rows.select(
        *rest, "origin", "url", *map(short, ("title", "application", "site")), F.when(
            F.length("html") <= HTML_CHARS, c("html"),
        ).otherwise("").alias("html"), c("_hosts").alias("hosts"), kept.alias("resources"), good_links.alias("links"),
        F.transform_values(
            counts, lambda k, v: F.when(is_count(k, v), v).otherwise(0),
        ).alias("counts"), F.struct(*[n.cast("int").alias(k) for k, n in lost.items()]).alias("dropped"), "_ok",
    )
    seen = Observation(name)
    sums = [F.sum(F.when(c("_ok"), c(f"dropped.{k}")).otherwise(0)).alias(k) for k in BOUNDS]
    return out.observe(seen, *sums, F.count(F.when(~c("_ok"), 1)).alias("refused")).where("_ok").drop("_ok"), seen


def bounded_files(spark: SparkSession, path: str, most: int, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(bodies, refused): files of at most `most` bytes, with path, length and content; and path and length of the others.

    The bound is part of the scan: it goes by the length that the file system tells, so what is over it is never opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select("path", "length", "content"), files.where(F.col("length") > most).select("path", "length")
