"""Rules that read a value several times compute it once, and say the same as before."""

from pyspark.sql import functions as F

from billsift import queries_captures, queries_discovery, queries_tracing
from billsift.functions import transforms, urls, values
from billsift.sources import captures, scans


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_claim_is_written_once(spark, sf_dir):
    assert len(_plan(queries_discovery.row_claims(spark, sf_dir))) < 40_000


def test_addresses_are_written_once(spark):
    df = spark.createDataFrame([("/billing/7?page=2#x", "https://e.com/a/b?c#d")], "u string, b string")
    route = df.select(urls.safe_route(scans.absolute(F.col("u"), F.col("b"))).alias("r"))
    assert len(_plan(route)) < 40_000
    assert route.first()["r"] == "https://e.com/billing/7?page=2"


def test_dates_are_those_of_all_forms(spark):
    texts = [
        "2024-01-02", "2024-1-2", "2024/01/02", "2024-01-02T03:04:05Z", "2024-01-02T23:04:05.123-02:00", "2024-01-02T03:04:05", "2024-01-02 03:04:05", "Jan 2, 2024", "january 2, 2024",
        "2 Feb 2024", "2 SEPTEMBER 2024", "Tue, 02 Jan 2024 03:04:05 GMT", "May 3, 2024", "Smarch 3, 2024", "", "x", "12:30", "2024-13-40", "2024-02-30", "31 Jun 2024", "INV-7", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace("t", "^[A-Za-z]{3,9}, (?=[0-9])", "")
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for _, f in transforms.FORMATS])
    for got, want in df.select(transforms.dated(F.col("t")), F.coalesce(F.date_format(at, "yyyy-MM-dd"), "t")).collect():
        assert got == want
    shown = [r[0] for r in df.select(values.displayed_date(F.col("t"))).collect()]
    assert shown == [
        "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-02-02", "2024-09-02", None, "2024-05-03",
    ] + [None] * 9


def test_replays_keep_a_small_plan(spark, sf_dir):
    assert len(queries_tracing.recipe_replays(spark, sf_dir)._jdf.queryExecution().toString()) < 400_000


def test_heavy_rows_of_a_small_file_are_spread(spark, sf_dir):
    names = ("row_claims", "redacted_fixtures", "evidence_bodies")
    assert all(getattr(queries_discovery, n)(spark, sf_dir).rdd.getNumPartitions() >= 8 for n in names)


def test_signs_keep_every_redaction(spark):
    texts = [
        "Token: abc, x", "email=a b", "bearer abcdefgh.1", "eyJ" + "a" * 25, "SK_live_abcdefghijklmn z", "api-abcdefghijkl", "?code=1&SIG=2", "A.b@c.De", "plain", "", None, "pk-test-aaaaaaaaaaaaaa",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, by in values.REDACTIONS:
        plain = F.regexp_replace(plain, pattern, by)
    assert all(a == b for a, b in df.select(values.redacted(F.col("t")), plain).collect())


def test_captured_addresses_are_written_once(spark, sf_dir):
    df = spark.createDataFrame([("https://a.se/users/jane?id=7654321&id=2&page=1&page=x'y#h",)], "u string")
    told = df.select(captures.sanitised_url(F.col("u"), aliased=True).alias("t"))
    assert len(_plan(told)) < 20_000
    assert told.first()["t"] == f"https://a.se/users/{captures.MARK}jane{captures.END}?id={captures.MARK}7654321{captures.END}&page=REDACTED"


def test_captures_of_a_small_file_are_spread(spark, sf_dir):
    assert queries_captures.captured_bodies(spark, sf_dir).rdd.getNumPartitions() >= 8


def test_marked_identifiers_and_addresses_keep_their_places(spark):
    df = spark.createDataFrame([(1, "s", '{"id":7654321,"url":"/users/jane","x":{"id":7654321,"to":"https://a.se/"},"y_id":1234567}')], "n int, s string, b string")
    rows = df.withColumn("t", F.lit("application/json")).withColumn("u", F.lit("/?id=1234567"))
    got = captures.captured(rows, "s", ["n"], "u", "b", "t").first()
    assert got["value"] == '{"id":"ref_1","url":"/users/REDACTED","x":{"id":"ref_1","to":"https://a.se/"},"y_id":"ref_2"}' and got["url"] == "/?id=__ref_2__"
