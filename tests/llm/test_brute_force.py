"""Operators against plain Python over whole small tables, and hard cases: nulls, empty texts, repeated rows."""

import hashlib
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from billsift.llm import chat, decontamination, html_extraction, language_id, lm_scoring, merkle, registry, secrets, sharding, simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with nulls, empty, blank and repeated texts, and an empty benchmark."""
    root = tmp_path_factory.mktemp("small")
    rows = [
        (0, None, None, "a", 0), (1, "", "en", None, 0), (2, " \t\n", "en", "a", 3), (3, "the quick brown fox", "en", "a", 19),
        (4, "the quick brown fox", "en", "a", 19), (5, "x" * 50_000, "de", "b", 50_000), (5, "x" * 50_000, "de", "b", 50_000),
        (6, "Ünï çödé \U0001f600 ﬁ", "fr", "b", 11),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(0, "http://a", None), (1, "http://b", "")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.mark.parametrize("name", registry.queries())
def test_hard_cases(spark, small, name):
    rows = registry.queries()[name](spark, small).collect()
    assert len(rows) == {"op4_html": 2, "op7_chat": 0, "op12_search": 0}.get(name, 8)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_simhash(spark, sf_dir, texts):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    prints = {i: brute(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_secrets_base(spark, sf_dir, texts):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for r in secrets.op3_secrets(spark, sf_dir).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(texts[r["doc_id"]] or "") if ok(m))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in found) for k in range(3))


def test_secrets_structure():
    import base64
    import json

    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    good = f"{enc({'alg': 'HS256'})}.{enc({'sub': 'me'})}.c2ln"
    assert [k for _, k, _ in secrets.scan(f"see {good} there")] == [secrets.KINDS.index("signed_token")]
    assert not secrets.scan(f"see {enc({'kid': 1})}.{enc({'sub': 'me'})}.c2ln there")


def sec1(n):
    """A made-up elliptic-curve key of `n` secret bytes."""
    inner = b"\x02\x01\x01\x04" + bytes([n]) + bytes((37 * i + 5) % 256 for i in range(n))
    return b"\x30" + bytes([len(inner)]) + inner


@pytest.mark.parametrize("n", [30, 31, 32, 60])
@pytest.mark.parametrize("form", ["prose after", "prose after, padded", "line before", "word before", "wrapped, prose after", "two", "alone"])
def test_secrets_key_among_lines(n, form):
    import base64
    import textwrap

    key = base64.b64encode(sec1(n)).decode()
    bare, wrapped = key.rstrip("="), "\n".join(textwrap.wrap(base64.b64encode(sec1(n)).decode().rstrip("="), 44))
    text, found = {
        "prose after": (f"see {bare}\nThis is\nmore", [bare]), "prose after, padded": (f"see {key}\nThis is", [key]), "line before": (f"{'ab' * 32}\n{bare}\nThis is", [bare]),
        "word before": (f"see my_{bare}\nThis", [bare]), "wrapped, prose after": (f"see {wrapped}\nThis\nis", [wrapped]), "two": (f"{bare}\n{bare}\nThis", [bare, bare]), "alone": (key, [key]),
    }[form]
    got = [text[a:b] for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "encoded_key"]
    assert got == found
    assert not [k for _, k, _ in secrets.scan(text.replace(bare[:12], "A" * 12).replace(wrapped[:12], "A" * 12)) if secrets.KINDS[k] == "encoded_key"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n"])
@pytest.mark.parametrize("headers", [[], ["Comment: mine", ""], ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF", ""]])
def test_secrets_armour(end, headers):
    import base64

    data = bytes(range(7, 55)) if "DEK" in "".join(headers) else sec1(32)
    block = lambda data: end.join(["-----BEGIN EC PRIVATE KEY-----", *headers, base64.b64encode(data).decode(), "-----END EC PRIVATE KEY-----"])
    text = f'{{"key": "{block(data)}{end}"}}'
    assert [text[a:b] for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "private_key"] == [block(data)]
    assert not [k for _, k, _ in secrets.scan(block(data[:-1])) if secrets.KINDS[k] == "private_key"]


def test_secrets_deep_and_overlapping():
    import base64
    import json

    text = sec1(32)
    for level in range(8):
        text = base64.b64encode(text) if level % 3 else base64.b64encode(text).hex().encode()
        assert any(secrets.KINDS[k] in ("encoded_key", "hex_key") for _, k, _ in secrets.scan(f"see {text.decode()} there")), level
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    good = f"{enc({'alg': 'HS256'})}.{enc({'sub': 'me'})}.c2ln"
    text = f"see eyJub25l.{good} there"
    assert [text[a:b] for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "signed_token"] == [good]


def test_secrets_long_runs_take_linear_time():
    import base64
    import time

    began = time.time()
    lines = base64.encodebytes(b"All work and no play makes Jack a dull boy.\n" * 20_000).decode()
    assert not [k for _, k, _ in secrets.scan(lines) if k == 5] and time.time() - began < 20


@pytest.mark.parametrize("page, found", [
    (
        '<p>See <a href="/hidden-gems">these gems</a> now</p>', ["See these gems now"],
    ), ('<p aria-hidden="false">shown</p>', ["shown"]), ('<article data-title="The Hidden Life"><p>one<p>two</article>', ["one", "two"]),
    ("<p class=hidden-x data-hidden>shown</p>", ["shown"]), (
        "<p hidden>not</p><p HIDDEN=''>not</p><p title='a' hidden/>not</p><p style='color:red; display: none'>not</p><p data-style='display:none'>shown</p>",
        ["shown"],
    ),
    *[
        (f"<p>one</p><{t}><p>two</p><p>three</p>", ["one", "two", "three"]) for t in (
            "svg", "math", "object", "canvas", "select", "noscript", "template", "iframe",
        )
    ],
    ("<p>one</p><svg><path d='M0'><p>two</p><p>three</p>", ["one", "two", "three"]), ("<div><svg><g></div><p>two</p><p>three</p>", ["two", "three"]),
    *[(f"<p>one</p><{t}>two", ["one"]) for t in ("script", "style", "textarea", "title")],
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>TeX</annotation></math> then</p>", ["if x=1 then"]), (
        "<p>an <svg viewBox='0 0 1 1'><path d='M0 0'/><g><path d='M1'></path></g></svg> icon</p><p>next</p>", ["an icon", "next"],
    ),
    (
        "<p>a <object data=x>fallback</object> text</p><noscript><p>plain</p></noscript>", ["a fallback text", "plain"],
    ), ("<svg><text>A</text><text>B</text></svg><p>c", ["A B", "c"]),
])
def test_html_keeps_what_is_shown(page, found):
    assert [b.text for b in html_extraction.blocks_of(page)] == found


def test_lm_base(spark, sf_dir, texts):
    from collections import Counter
    from math import log10

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + [None]
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in cut(t))
    total, distinct = sum(counts.values()), len(counts)
    for r in lm_scoring.op5_lm(spark, sf_dir).collect():
        words = cut(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), total)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0


def test_lm_learns_over_words(spark):
    """Words in the order that was learnt score better than the same words in another, also beyond the size of a part."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    text = " ".join(words * 30)
    other = words[:]
    rng.shuffle(other)
    docs = spark.createDataFrame(
        [(i, text, True) for i in range(20)] + [(100, text, False), (101, " ".join(other * 30), False)], "doc_id long, text string, learn boolean",
    )
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, F.col("learn")).collect()}
    assert got[100] > 0.5 * got[101]


def test_lm_parts_carry_contexts(monkeypatch):
    """Cut into parts or not, a text's bits have the same contexts; those see over blanks."""
    import numpy as np

    tree = lm_scoring.Trees(np.arange(lm_scoring.SYMBOLS**2).reshape(lm_scoring.SYMBOLS, -1))
    for text in (b"", b" ", b"one two  three four " * 9 + b"x" * 300 + b" end", b"y" * 500, b" a b c d" * 40):
        whole = lm_scoring.events(tree, [*lm_scoring.parts_of(b"before this"), *lm_scoring.parts_of(text)])
        slots = np.stack(whole[1])[:, whole[0] == 1]
        for size in (1, 3, 7, 64):
            monkeypatch.setattr(lm_scoring, "PART", size)
            cut = lm_scoring.events(tree, list(lm_scoring.parts_of(text)))
            monkeypatch.undo()
            assert (np.stack(cut[1]) == slots).all() and (cut[2] == whole[2][whole[0] == 1]).all() and (cut[3] == whole[3][whole[0] == 1]).all()
    a, b = (lm_scoring.events(tree, [lm_scoring.Part(t)])[1] for t in (b"one same same", b"two same same"))
    end = slice(-int(tree.size[ord("e") * lm_scoring.SYMBOLS + lm_scoring.END]), None)
    assert all((x[end] == y[end]).all() for x, y in zip(a, b))  # two words back no more
    a, b = (lm_scoring.events(tree, [lm_scoring.Part(t)])[1] for t in (b"one same", b"two same"))
    assert (a[4][end] == b[4][end]).all() and (a[5][end] != b[5][end]).any()


def test_lm_counts_are_exact():
    """Counts that no float32 holds stay exact."""
    import numpy as np

    for top in (200, 60_000, (1 << 24) + 1, (1 << 40) + 1):
        counts = np.zeros(lm_scoring.SEGMENT * 2, np.int64)
        counts[3] = top
        assert (lm_scoring._unpacked(lm_scoring._packed(counts)) == counts).all()


def test_bpe_round_trip(spark, sf_dir, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from billsift.llm import bpe

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain.no_truncation(), plain.no_padding()
    for r in bpe.op6_bpe(spark, sf_dir).collect():
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_is_predicted(spark, sf_dir):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{sf_dir}/documents.parquet') WHERE lang IS NOT NULL").fetchall())
    held = [r for r in language_id.op9_language_id(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_merkle_digests(spark, sf_dir, texts):
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    rows = merkle.op10_merkle(spark, sf_dir).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    for r in rows:
        own, other = texts[r["doc_id"]] or "", texts[following[r["doc_id"]]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert r["n_chars"] == len(own) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (edited == own) == (r["fingerprint"] == r["edited_fingerprint"])
    assert len(set(prints.values())) == len({texts[i] or "" for i in texts})


def test_shards_are_even():
    table = sharding.lookup_table([f"s{i}" for i in range(7)])
    sizes = [table.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_decontamination_blocks(spark):
    docs = spark.createDataFrame([(1, "one two THREE four five six seven eight nine ten eleven"), (2, "clean"), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "One, two three four five six seven eight nine ten!"), (8, "clean air"), (9, None)], "item_id long, text string")
    one_block, many = (docs.select("doc_id", decontamination.scan_column(F.col("text"), bench, size)["n_hit"].alias("n")) for size in (10**6, 20))
    assert sorted(map(tuple, one_block.collect())) == sorted(map(tuple, many.collect())) == [(1, 10), (2, 0), (3, 0)]
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()]
    leaks = {r["doc_id"] for r in decontamination.op2_decontamination(spark, sf_dir).where("contaminated").collect()}
    assert ids and len(ids) == len(set(ids)) and not leaks & set(ids)
    assert chat.ORACLE_SQL
