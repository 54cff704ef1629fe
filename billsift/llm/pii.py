"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans, strict and loose ones. Five labelers vote on
each, for (+1), against (-1) or not at all (0): its form (check digits, ranges),
a gazetteer (top-level domains, calling codes, issuer numbers, given names), cue
words before it, its borders, and its shape. Expectation-maximisation over the
counted vote patterns estimates each labeler's reliability for each kind, and so
how likely each pattern is personal data. These likelihoods are the soft labels
on which a logistic classifier over the spans' own features is trained; it
decides about all candidates that the strict patterns alone do not settle.

Texts are read once, row by row; candidates are written to the shared folder.
Only counts of vote patterns and of features move, and their number has a bound
that does not depend on the data (PATTERNS and FEATURES below); the two small
fits run on them on the driver. The results go back into the plan as literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "iban", "name")

# The patterns of the base kinds. Runs are possessive and begin where a run begins, which finds the same
# spans in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Loose forms; they are looked for where no candidate of a base kind stands.
SPELT = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+[\[({]\x20?+(?i:at)\x20?+[\])}]\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?+[\[({]\x20?+(?i:dot)\x20?+[\])}]\x20?+)[A-Za-z0-9-]++)++"
COLONS = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
LOCAL = r"(?<![0-9(])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}+[0-9]{2,5}){1,4}+(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora|Sra"
NAME = rf"(?<![\p{{L}}])(?:{TITLES})\.?+\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++){{0,2}}+"

# Gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|uk|de|fr|es|it|nl|se|no|dk|fi|pl|pt|ch|at|be|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|ua|tr|za"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]\d|3[578]\d|42\d|50\d|59\d|6[789]\d|8[0578]\d|9[679]\d)"
ISSUERS = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|6(?:011|5\d\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14})$"
RESERVED = r"^0*(?:0|10|127|169\.254|172\.(?:1[6-9]|2\d|3[01])|192\.168|2(?:2[4-9]|[345]\d))\."
BANKS = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM"
GIVEN = "Anna|Anne|Carlos|Carmen|Charles|Claire|David|Elena|Emma|Eva|Hans|Isabel|James|Jan|Jean|John|José|Juan|Julia|Karl|Laura|Lena|Luis|Maria|María|Marie|Mary|Michael|Michel|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas|William"
CUES = {
    "email": "e-?mail|mail|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|address|addr|client|peer|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "name": "name|dear|signed|sincerely|regards|contact|attn",
}
AGAINST = "order|invoice|isbn|issn|serial|version|release|build|sku|ref|chapter|section|figure|table|page|year|total|price|bestellung|rechnung|facture|factura|version"

LABELERS = ("form", "gazetteer", "cue", "border", "shape")
PATTERNS = len(KINDS) * 3 ** len(LABELERS)
#: What the first guess gives each labeler's vote, and what it asks for.
FIRST, LEAST = (3.0, 1.0, 2.0, 0.5, 0.5), 1.5
ROUNDS = 40
#: The classifier's features and how many values each has.
FEATURES = {"source": 9, "form": 3, "gazetteer": 3, "cue": 3, "shape": 3, "before": 5, "after": 5, "digits": 7, "between": 5}
CHUNK = 256
CONTEXT = 48


def running(steps: Column) -> Column:
    """The sum of all numbers before each one; chunk by chunk, so that long arrays take no quadratic time."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(xs: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, CHUNK))
    long = F.flatten(F.zip_with(chunks, sums(F.transform(chunks, total), zero), sums))
    return F.when(F.size(steps) <= CHUNK, sums(steps, zero)).otherwise(long)


def cut(text: Column, pattern: str, where: Column) -> Column:
    """The matches of `pattern` and the texts between them (one more); none where `where` is false."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("hits"),
        F.when(where, F.split(text, pattern, -1)).otherwise(none).alias("gaps"),
    )


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's test."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def is_ip(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def is_iban(hit: Column) -> Column:
    """Whether the number, its first four characters moved to its end and letters counted from 10, leaves 1 when divided by 97."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), ""), F.lit(0),
        lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )
    return rest == 1


def vote(yes: Column, no: Column | bool = False) -> Column:
    """1, -1 or 0."""
    return F.when(yes, 1).when(F.lit(no) if isinstance(no, bool) else no, -1).otherwise(0)


def _either(yes: Column) -> Column:
    return vote(yes, ~yes)


def _grouped(digits: Column) -> Column:
    """For numbers: not one digit again and again."""
    return F.size(F.array_distinct(F.split(digits, ""))) > 2


#: For each source of candidates: its kind, pattern, which hits are candidates, form, gazetteer and shape.
Source = tuple[str, str, Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]
_any = lambda h: F.lit(True)
_domain = lambda h: _either(F.lower(h).rlike(rf"[^a-z](?:{DOMAINS})$"))
_address = lambda h: _either(~h.rlike(r"^\.|\.\.|\.@|^.{65}"))
BASE: dict[str, Source] = {
    "email": ("email", EMAIL, _any, lambda h: F.lit(1), _domain, _address),
    "ip": ("ip", IP, _any, lambda h: _either(is_ip(h)), lambda h: _either(~h.rlike(RESERVED)), lambda h: _either(~h.rlike(r"(?:^|\.)0\d"))),
    "card": (
        "card", CARD, lambda h: F.length(digits_of(h)).between(13, 19), lambda h: _either(passes_luhn(digits_of(h))),
        lambda h: _either(digits_of(h).rlike(ISSUERS)),
        lambda h: _either(h.rlike(r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})$") & _grouped(digits_of(h))),
    ),
    "phone": (
        "phone", PHONE, lambda h: F.length(digits_of(h)).between(7, 17), lambda h: _either(F.length(digits_of(h)).between(9, 15)),
        lambda h: _either(h.rlike(CALLING)), lambda h: _either(~h.rlike(r"[ ().-]{4}|\([^)]*\(") & _grouped(digits_of(h))),
    ),
}
LOOSE: dict[str, Source] = {
    "spelt": ("email", SPELT, _any, lambda h: F.lit(0), lambda h: _either(F.lower(h).rlike(rf"[^a-z](?:{DOMAINS})$")), lambda h: _either(~h.rlike(r"^.{100}"))),
    "colons": (
        "ip", COLONS, lambda h: F.length(F.regexp_replace(h, "[^:]", "")) >= 2,
        lambda h: vote(h.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), ~h.rlike("::")),
        lambda h: vote(h.rlike("(?i)^2[0-9a-f]{3}:"), h.rlike("(?i)^(?:fe80|::1|f[cd])")),
        lambda h: vote(h.rlike("[A-Fa-f]"), h.rlike(r"^\d\d?:\d\d:\d\d$")),
    ),
    "local": (
        "phone", LOCAL, lambda h: F.length(digits_of(h)).between(7, 15),
        lambda h: vote(h.rlike(r"^(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}$"), h.rlike(r"^(?:19|20)\d\d|(?:19|20)\d\d$")),
        lambda h: vote(h.rlike(r"^\(?0[1-9]"), h.rlike(r"^\(?00")), lambda h: _either(_grouped(digits_of(h)) & ~h.rlike(r"[./].*[ -]|[ -].*[./]")),
    ),
    "iban": (
        "iban", IBAN, _any, lambda h: _either(is_iban(h)), lambda h: _either(h.rlike(f"^(?:{BANKS})")),
        lambda h: _either(h.rlike(r"^\S+$|^\S{4}(?: \S{4})+(?: \S{1,3})?$")),
    ),
    "name": ("name", NAME, _any, lambda h: F.lit(1), lambda h: vote(h.rlike(rf"\b(?:{GIVEN})\b")), lambda h: vote(h.rlike(r"\x20\S+\x20"))),
}
SOURCES = (*BASE, *LOOSE)


def _class(c: Column) -> Column:
    """The kind of a single character: none, blank, letter, digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike(r"^\d"), 3).otherwise(4)


def _candidates(found: Column, name: str, source: Source) -> Column:
    """The candidates that one source gives: number of the kind, start, end, votes, features; base ones marked."""
    kind, _, fits, form, gazetteer, shape = source
    hits, gaps = found["hits"], found["gaps"]
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: (F.length(h) + F.length(g)).cast("long"))
    rows = F.arrays_zip(
        hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("before"), F.slice(gaps, 2, F.size(hits)).alias("after"), running(steps).alias("at"),
    )

    def one(x: Column) -> Column:
        hit, before, after = x["hit"], F.right(x["before"], F.lit(CONTEXT)), F.left(x["after"], F.lit(1))
        start = x["at"] + F.length(x["before"])
        left, right = _class(F.right(before, F.lit(1))), _class(after)
        spaced = lambda words: rf"(?i)(?<!\p{{L}})(?:{words})(?!\p{{L}})"
        n = F.length(digits_of(hit))
        bits = sum((hit.contains(s).cast("int") for s in "-."), hit.contains(" ").cast("int"))
        votes = [
            form(hit), gazetteer(hit), vote(before.rlike(spaced(CUES[kind])), before.rlike(spaced(AGAINST))),
            vote(~left.isin(2, 3) & ~right.isin(2, 3), left.isin(2, 3) & right.isin(2, 3)), shape(hit),
        ]
        values = {
            "source": F.lit(SOURCES.index(name)), "before": left, "after": right,
            "digits": F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 13, 4).when(n < 17, 5).otherwise(6),
            "between": F.when(bits > 1, 4).when(hit.contains(" "), 1).when(hit.contains("-"), 2).when(hit.contains("."), 3).otherwise(0),
        }
        votes = [v.cast("int") for v in votes]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.cast("long").alias("start"), (start + F.length(hit)).cast("long").alias("end"),
            (votes[0] == 1).alias("base") if name in BASE else F.lit(False).alias("base"), F.array(*votes).alias("votes"),
            F.array(*[values[f].cast("int") if f in values else F.lit(0) for f in FEATURES]).alias("features"),
        )

    return F.transform(F.filter(rows, lambda x: fits(x["hit"])), one)


def _hidden(found: Column, text: Column, fits: Callable[[Column], Column]) -> Column:
    """The text with its candidates overwritten by NUL, at the same length."""
    gaps, hits = found["gaps"], found["hits"]
    parts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.concat(g, F.when(fits(h), F.repeat(F.lit("\0"), F.length(h))).otherwise(h)))
    return F.when(F.size(hits) > 0, F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))).otherwise(text)


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a row of `docs`: its id, and all candidate spans of its text."""
    df = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("digit", F.col("text").rlike("[0-9]"))
    may = {
        "email": F.contains("text", F.lit("@")), "ip": F.col("digit") & F.contains("text", F.lit(".")), "card": F.col("digit"),
        "phone": F.col("digit") & F.contains("text", F.lit("+")),
    }
    df = df.select("id", "text", "digit", *[cut(F.col("text"), BASE[k][1], may[k]).alias(k) for k in BASE])
    df = df.withColumn("rest", _hidden(F.col("email"), F.col("text"), BASE["email"][2]))
    for k in ("phone", "ip", "card"):
        df = df.withColumn("again", cut(F.col("rest"), BASE[k][1], may[k])).withColumn("rest", _hidden(F.col("again"), F.col("rest"), BASE[k][2]))
    may = {
        "spelt": F.col("rest").rlike(r"(?i)[\[({]\x20?at\x20?[\])}]"), "colons": F.contains("rest", F.lit(":")), "local": F.col("digit"),
        "iban": F.col("digit"), "name": F.col("rest").rlike(rf"(?:{TITLES})\.?\x20\p{{Lu}}"),
    }
    df = df.select("id", *BASE, *[cut(F.col("rest"), LOOSE[k][1], may[k]).alias(k) for k in LOOSE])
    return df.select("id", F.concat(*[_candidates(F.col(k), k, s) for k, s in (BASE | LOOSE).items()]).alias("found"))


def pattern_of(kind: Column, votes: Column) -> Column:
    """The number of a vote pattern: from 0 to PATTERNS - 1."""
    return F.aggregate(votes, kind, lambda a, v: a * 3 + v + 1)


def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> list[float]:
    """How likely each vote pattern (by number) is personal data, by expectation-maximisation over counted patterns.

    For each kind: a prior, and how each labeler votes on personal data and on other spans. Labelers are taken as
    independent given the truth; a small prior count lets them rather agree with it.
    """
    size = 3 ** len(LABELERS)
    votes = [[p // 3 ** (len(LABELERS) - 1 - j) % 3 - 1 for j in range(len(LABELERS))] for p in range(size)]
    first = [1 / (1 + math.exp(LEAST - sum(w * v for w, v in zip(FIRST, vs)))) for vs in votes]
    out: list[float] = []
    for k in range(len(KINDS)):
        seen = {p: n for p in range(size) if (n := counts.get(k * size + p))}
        truth = list(first)
        for _ in range(rounds):
            prior = (1 + sum(n * truth[p] for p, n in seen.items())) / (2 + sum(seen.values()))
            heard = []  # for each labeler: log of how much likelier each vote is on personal data
            for j in range(len(LABELERS)):
                yes, no = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
                for p, n in seen.items():
                    yes[votes[p][j] + 1] += n * truth[p]
                    no[votes[p][j] + 1] += n * (1 - truth[p])
                heard.append([math.log(y / sum(yes)) - math.log(n / sum(no)) for y, n in zip(yes, no)])
            odds = math.log(prior) - math.log(1 - prior)
            truth = [1 / (1 + math.exp(-max(min(odds + sum(h[v + 1] for h, v in zip(heard, vs)), 500.0), -500.0))) for vs in votes]
        out += truth
    return out


def classifier(rows: Sequence[tuple[list[int], int, float]], rounds: int = 300, ridge: float = 1.0) -> list[list[float]]:
    """A weight for each value of each feature: logistic regression on (feature values, count, sum of soft labels).

    Each round moves every weight by its own Newton step, halved as the features overlap; `ridge` keeps weights of rare
    values small.
    """
    weights = [[0.0] * n for n in FEATURES.values()]
    for _ in range(rounds):
        slope = [[ridge * w for w in ws] for ws in weights]
        curve = [[ridge] * len(ws) for ws in weights]
        for values, n, label in rows:
            p = 1 / (1 + math.exp(-max(min(sum(ws[v] for ws, v in zip(weights, values)), 500.0), -500.0)))
            for f, v in enumerate(values):
                slope[f][v] += n * p - label
                curve[f][v] += n * p * (1 - p)
        for ws, ss, cs in zip(weights, slope, curve):
            for v in range(len(ws)):
                ws[v] -= ss[v] / cs[v] / len(weights)
    return weights


def _literal(numbers: Sequence[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row a row of `docs`: its id and `spans`, an array of (kind, start, end, base, likelihood) by kind, then start.

    Offsets are code points, ends exclusive. Base spans always stay. Other candidates are reported if the classifier
    gives at least `least`, and their form and the cues before them together speak for them; a form that fails its check never is. Null and empty texts have no spans; repeated
    rows each have theirs; an empty table gives no rows. Other columns are not read.
    """
    # four of the votes are features as well: what the classifier adds is how they go together with the surroundings
    df = candidates(docs, id, text)
    names, at = list(FEATURES), {"form": 0, "gazetteer": 1, "cue": 2, "shape": 4}
    full = lambda c: F.array(*[c["votes"][at[f]] + 1 if f in at else c["features"][i] for i, f in enumerate(names)])
    df = df.withColumn(
        "found",
        F.transform(
            "found",
            lambda c: F.struct(
                c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
                pattern_of(c["kind"], c["votes"]).alias("pattern"), full(c).alias("features"),
            ),
        ),
    )
    df = common.written(df, "candidates")
    each = df.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.*")
    truth = reliabilities({r["pattern"]: r["count"] for r in each.groupBy("pattern").count().collect()})
    rows = each.groupBy("features").agg(
        F.count("*").alias("n"), F.sum(F.round(F.element_at(_literal(truth), F.col("pattern") + 1) * 1e6).cast("long")).alias("label"),
    ).collect()
    weights = classifier(sorted((list(r["features"]), r["n"], r["label"] / 1e6) for r in rows))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    cue, form = names.index("cue"), names.index("form")

    def judged(c: Column) -> Column:
        score = sum((F.element_at(_literal(ws), c["features"][f] + 1) for f, ws in enumerate(weights)), F.lit(0.0))
        return F.struct(
            c["kind"].alias("rank"), F.element_at(kinds, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            c["base"].alias("base"), ((c["features"][cue] + c["features"][form] >= 3) & (c["features"][form] > 0)).alias("said"),
            (1 / (1 + F.exp(-score))).alias("likelihood"),
        )

    chosen = F.filter(F.transform("found", judged), lambda c: c["base"] | c["said"] & (c["likelihood"] >= least))
    sorted_ = F.array_sort(F.transform(chosen, lambda c: F.struct(c["rank"], c["start"], c["end"], c["kind"], c["base"], c["likelihood"])))
    return df.select(
        F.col("id").alias(id), F.transform(sorted_, lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"], c["likelihood"])).alias("spans"),
    )


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans counted by kind, with digests, and all spans."""
    found = find(common.documents(spark, sf_dir))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",",
    )
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
