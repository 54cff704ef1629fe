"""The methods against slow, plain versions, and cases that a table seldom has."""

import base64
import hashlib
import itertools
import math
import random
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from billsift.llm import bpe, chat, common, decontamination, html_extraction, language_id, lm_scoring, merkle, registry, secrets, sharding, simhash


# Language ID


def brute_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        out.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    return out


def number(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    return sum(c << 21 * i for i, c in enumerate(reversed(codes))) | (language_id.PAIR if len(gram) == 2 else 0)


@pytest.mark.parametrize("text", [None, "", " .,1 ", "a", "Ab c", "ÀÉ ß İ straße", "x" * 9 + "-y z2z", "中文 字", "word " * 50])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_ngrams(monkeypatch, text, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    grams, times = language_id.ngrams_of(text)
    assert dict(zip(grams.tolist(), times.tolist())) == {number(g): n for g, n in brute_grams(text).items()}
    assert [language_id.shown(g).replace("_", " ") for g in grams.tolist()] == sorted(brute_grams(text), key=number)


def test_language_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{sf_dir}/documents.parquet')").fetchall()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang in rows:
        if lang and text and not held_out(i):
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    depth = language_id.DEPTH
    profiles = {k: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:depth])} for k, c in counts.items()}
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, sf_dir).collect()}
    for i, text, _ in rows[:120]:
        own = brute_grams(text)
        ranks = {g: sum(m > n for m in own.values()) for g, n in own.items()}
        top = {g: r for g, r in ranks.items() if r < depth}
        apart = {k: sum(abs(p[g] - r) if g in p else depth for g, r in top.items()) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get) if top else "und"
        assert got[i]["lang_pred"] == best and got[i]["held_out"] == held_out(i)
        assert got[i]["score"] == pytest.approx(1 - apart[best] / (depth * len(top)) if top else 0)


# Merkle trees


def test_edits_are_located():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 8))) for _ in range(200)]
    for _ in range(40):
        text = [" ".join(rng.choices(words, k=rng.choice([0, 3, 30]))) for _ in range(rng.randint(1, 40))]
        at = rng.randrange(len(text))
        other = text[:at] + [text[at] + " changed here."] + text[at + 1 :]
        a, b = (merkle.fingerprint("\n".join(t)) for t in (text, other))
        assert merkle.differing(a, b)[1] == [at] and at in merkle.differing(a, b)[0] + [at]
        assert merkle.likeness(a, a) == 1 and 0 <= merkle.likeness(a, b) < 1 and merkle.likeness(a, b) == merkle.likeness(b, a)
        leaves = lambda t: Counter(x for p in t for x in merkle.LEAF.findall(p))
        x, y = leaves(text), leaves(other)
        assert merkle.likeness(a, b) == pytest.approx(2 * (x & y).total() / max((x + y).total(), 1), abs=0.02)
    assert merkle.fingerprint(None) == merkle.fingerprint("") != merkle.fingerprint(" ")
    assert merkle.ranges([0, 1, 2, 5, 7, 8]) == "0-2,5,7-8"


# Secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (lambda n: bytes([0x80 | len(n)]) + n)(len(body).to_bytes((len(body).bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def made_keys():
    rng = random.Random(9)
    many = lambda n: bytes(rng.randrange(1, 128) for _ in range(n))
    field = lambda b: struct.pack(">I", len(b)) + b
    inner = b"\x01\x02\x03\x04" * 2 + field(b"ssh-ed25519") + field(many(32)) + field(many(64)) + field(b"me")
    inner += bytes(range(1, 1 + -len(inner) % 8))
    yield "rsa", der(0x30, der(2, b"\0"), *[der(2, many(n)) for n in (64, 3, 64, 32, 32, 32, 32, 32)])
    yield "pkcs8", der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, many(60)))
    yield "encrypted", der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d"), der(0x30, many(20))), der(4, many(64)))
    yield "ssh", secrets.MAGIC + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(field(b"ssh-ed25519") + field(many(32))) + field(inner)


@pytest.mark.parametrize("kind, key", list(made_keys()))
def test_planted_keys_are_found(kind, key):
    """Every place and form: behind signs, letters and odd digits, in lines, urlsafe, in hex; broken ones never."""
    plain = base64.b64encode(key).decode()
    for before in ("", "x ", "path/", "my_", "abc", "k=", "Zz9"):
        for shown in (plain.rstrip("="), plain.translate(str.maketrans("+/", "-_")).rstrip("=")):
            text = f"see {before}{shown}\nand on"
            assert shown in [text[a:b] for a, k, b in secrets.scan(text) if k == 5], (kind, before)
    for digit in ("", "a", "7f"):
        text = f"x {digit}{key.hex()} y"
        assert key.hex() in [text[a:b] for a, k, b in secrets.scan(text) if k == 6]
    broken = key[:5] + bytes([key[5] ^ 0x55]) + key[6:-3]
    assert not [k for _, k, _ in secrets.scan(f"see {base64.b64encode(broken).decode()} {broken.hex()}") if k in (5, 6)]


def test_masks():
    assert secrets.scan(None) == secrets.scan("") == []
    text = "a token = abcdef1 b"
    assert [text[a:b] for a, _, b in secrets.scan(text)] == ["token = abcdef1"]


# Main text


PAGES = [
    (
        "<body><div class='nav menu'><a href=/a>Home</a> <a href=/b>About us</a></div><main><h1>How bees see</h1><p>Bees see light that we do not, and flowers show it.</p><ul><li>Blue is bright to them.</li><li>Red is dark.</li></ul></main><footer>© 2020 Bees Ltd</footer>",
        ["How bees see", "Bees see light that we do not, and flowers show it.", "Blue is bright to them.", "Red is dark."],
    ),
    (
        "<header><p>Daily News</p></header><div id=story><h2>Rain again</h2><p>It rained in the north for the ninth day, officials said on Monday.<p>More is on its way.</div><aside><h3>Related</h3><a href=/x>Sun at last</a></aside><section id=comments><h3>Comments</h3><p>First! I like rain very much, thank you all.</p></section>",
        ["Rain again", "It rained in the north for the ninth day, officials said on Monday.", "More is on its way."],
    ),
    (
        "<nav><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></nav><div class=cookie-banner><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article><h1>On soups</h1><p>Stock first: bones, water, patience.</p><blockquote>Soup is a conversation, she said.</blockquote><p>Salt last.</p></article>",
        ["On soups", "Stock first: bones, water, patience.", "Soup is a conversation, she said.", "Salt last."],
    ),
    (
        "<div class=ad>Buy two, get one free today only at our shop!</div><section class=post-body><h1>Knots</h1><p>The bowline holds &amp; is easily undone.</p><pre>over under through</pre></section><form class=search><p><label>Search</label><input name=q></p></form><footer><p>Imprint</p></footer>",
        ["Knots", "The bowline holds & is easily undone.", "over under through"],
    ),
]


def test_main_text_of_pages_made_by_hand():
    """Not from the generator of the training pages: precision and recall by block."""
    field = html_extraction.trained()
    found = [html_extraction.main_text(field, page).split("\n\n") for page, _ in PAGES]
    good = sum(len(set(f) & set(want)) for f, (_, want) in zip(found, PAGES))
    assert good >= 0.9 * sum(map(len, found)) and good >= 0.9 * sum(len(want) for _, want in PAGES)
    assert html_extraction.main_text(field, None) == html_extraction.main_text(field, "<p> </p>") == ""


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(30):
        field = html_extraction.Field(rng.normal(size=html_extraction.WIDTH), rng.normal(size=(2, 2)))
        blocks = html_extraction.blocks_of("".join(f"<{t} class=c{i}>word {i}.</{t}>" for i, t in enumerate(rng.choice(["p", "div", "li", "h1"], 5))))
        unary = [sum(field.weights[f]) for f in html_extraction.all_features(blocks)]
        worth = lambda y: sum(u for u, l in zip(unary, y) if l) + sum(field.pairs[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, E741
        assert worth(field.decode(blocks)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=len(blocks)))))


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 60_000, "<a " * 300_000, "<iframe>x" * 60_000, "".join(f"<div class=c{i}>x" for i in range(40_000)), "<a title='x>" * 60_000,
        "<" * 400_000, "<svg><p>x" * 40_000,
    ],
)
def test_pages_take_linear_time(page):
    began = time.time()
    field = html_extraction.Field(np.zeros(html_extraction.WIDTH), np.zeros((2, 2)))
    html_extraction.main_text(field, page)
    assert time.time() - began < 20


# Language model


def test_lm_against_one_bit_at_a_time():
    """The model's score, with contexts and levels worked out in plain Python."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two", "three", "vier", "x" * 40], k=rng.randint(0, 60))).encode() for _ in range(30)] + [b"", b" ", b"\xff\x00"]
    row = [256, *itertools.chain.from_iterable([*t, 256] for t in texts)]
    counts = np.zeros((257, 257), np.int64)
    np.add.at(counts, (row[:-1], row[1:]), 1)
    trees = lm_scoring.Trees(counts)
    learner = lm_scoring.Learner(trees)
    learner.turn = 500
    learner.read(texts)
    learner.count()
    own = learner.model.mixer
    model = lm_scoring.Model(trees, learner.model.logits, lm_scoring.Mixer(own.weights, own.hits))
    mask, key, factor = lm_scoring.MASK, int(lm_scoring.KEY), lm_scoring.FACTOR
    shift = 64 - trees.slots_bits

    def brute(text):
        symbols, total = [*text, 256], 0.0
        bits, made, piece, before = 0.0, 0, [], 7
        whole = lambda p: sum((s + 3) * pow(factor, i, 1 << 64) for i, s in enumerate(p)) & mask
        for n, symbol in enumerate(symbols):
            back = [s + 3 for s in reversed(symbols[max(n - 4, 0) : n])] + [1] * 4
            contexts, rolled = [], 0
            for k in range(1, 5):
                rolled = (rolled * key + back[k - 1]) & mask
                contexts.append((rolled + k) & mask)
            so_far = (whole(piece) + 0xC2B2AE3D27D4EB4F + len(piece)) & mask
            mixed = ((before ^ before >> 29) * 0xBF58476D1CE4E5B9) & mask
            contexts += [so_far, ((so_far ^ so_far >> 27) * 0x94D049BB133111EB + (mixed ^ mixed >> 32)) & mask]
            slots = [((c ^ c >> 31) * key & mask) >> shift for c in contexts]
            path = (symbols[n - 1] if n else 256) * 257 + symbol
            for j in range(trees.start[path], trees.start[path] + trees.size[path]):
                gate = int(trees.depth[j]) * lm_scoring.PLACES + min(len(piece), lm_scoring.PLACES - 1)
                x = sum(int(model.logits[k, s ^ trees.mark[j]]) * float(model.mixer.weights[k, gate]) for k, s in enumerate(slots)) / lm_scoring.STEPS
                p = 1 / (1 + math.exp(-x))
                level = sum(bits > b * made for b in lm_scoring.LEVEL_BITS) if made >= lm_scoring.EARLY else 1
                bucket = min(max(int(x * (lm_scoring.BUCKETS - 1) / (2 * lm_scoring.REACH) + lm_scoring.BUCKETS / 2), 0), lm_scoring.BUCKETS - 1)
                cell = (gate * lm_scoring.LEVELS + level) * lm_scoring.BUCKETS + bucket
                q = float(model.mixer.base[cell] + model.mixer.slope[cell] * p)
                total += math.log10(q if trees.bit[j] else 1 - q)
                bits -= math.log2(p if trees.bit[j] else 1 - p)
                made += 1
            if symbol == 32:
                before, piece = whole(piece), []
            else:
                piece.append(symbol)
        return total

    got = model.texts(texts)
    assert got == pytest.approx([brute(t) for t in texts], rel=1e-3)
    assert sum(abs(a - brute(t)) < 1e-4 * max(1, -a) for a, t in zip(got, texts)) >= len(texts) - 3  # a rounded logit may fall into the next cell


# Chat


def test_long_and_odd_conversations(spark):
    turns = [(1, n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(1000)]
    other = [(*t[:3], t[3] if t[1] < 700 else "else") for t in turns]
    odd = [(2, None, None, None), (2, 0, "assistant", "<|x"), (2, 0, "assistant", "<|x"), (None, 3, "user", "a"), (3, 1, "assistant", "alone")]
    schema = "pair_id long, turn long, role string, text string"
    got = {
        r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(turns + odd, schema), spark.createDataFrame(other + odd[:-1], schema)).collect()
    }
    assert set(got) == {1, 2, 3, None}
    shown = lambda rows: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, _, r, x in rows)
    one = got[1]
    assert (one["n_prompt_turns"], one["prompt"], one["chosen"], one["rejected"]) == (700, shown(turns[:700]), shown(turns[700:]), shown(other[700:]))
    assert [one["chosen"][m["start"] : m["end"]] for m in one["chosen_mask"]] == [f"turn {n}<|end|>\n" for n in range(701, 1000, 2)]
    assert [one["rejected"][m["start"] : m["end"]] for m in one["rejected_mask"]] == ["else<|end|>\n"] * 150
    assert got[2]["prompt"] == "<|assistant|>\n< |x<|end|>\n" * 2 + "<|unknown|>\n<|end|>\n" and got[2]["chosen"] == got[2]["rejected"] == ""
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["rejected"]) == ("", "<|assistant|>\nalone<|end|>\n", "")


# Near-duplicates and sharding


def test_pruning_loses_no_link(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {simhash.signed(base)} | {simhash.signed(base ^ sum(1 << b for b in rng.sample(range(64), k))) for k in (1, 2, 3, 4, 4, 5, 6)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    both = [sorted((r["a"], r["b"]) for r in simhash.links(df, prune).collect()) for prune in (True, False)]
    assert both[0] == both[1] and both[0]


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [
        (5, long, 1), (3, long, 2), (3, long, 2), (None, long, 3), (None, "no id here at all, my friend", 4),
        (None, "no id here at all, my friend", 4), (7, None, 5), (8, "", 6), (9, "a text of its own, with other words", 7),
        (9, "another text under the same id, quite different", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("kept_id", F.lit("x")).withColumn("root", F.col("fp"))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept.collect()) == [(0, 4), (3, 2), (7, 5), (9, 7), (9, 8)]


def test_clashing_shard_names(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "shard string, shard_slot int")
    out = sharding.place(df, ["shard"])
    assert sorted(out.columns) == ["shard", "shard_slot"] and out.count() == 3 and len({tuple(r) for r in out.collect()}) == 2


# All of them


def test_empty_tables(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"),
        ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name


def test_pipeline_against_plain_python(spark, tmp_path):
    """The whole pipeline over a small table: each stage once more in plain Python."""
    import corpus_pipeline
    import public_tokenizers
    import tokenizers

    rng = random.Random(6)
    english, german = ["the", "and", "house", "with", "water", "there", "light", "thing"], ["der", "und", "haus", "mit", "wasser", "schön", "licht", "nicht"]
    prose = lambda words, n: " ".join(rng.choices(words, k=n))
    texts = [(prose(english, 60), "en") for _ in range(8)] + [(prose(german, 60), "de") for _ in range(8)]
    leak = "seven green apples were hidden under the old wooden bridge"
    texts += [
        texts[0], texts[9], (None, "en"), ("", None), (" 12 34 .", "en"), (f"{prose(english, 30)} {leak} {prose(english, 30)}", None),
        (f"{prose(english, 40)} token = \"{'0a' * 20}\" {prose(english, 5)}", "en"), (texts[0][0], None),
    ]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in kept}
    group = {i: min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    assert all(group[group[i]] == group[i] for i in group)  # no chains here
    kept = [r for r in kept if group[r[0]] == r[0]]
    kept = [r for r in kept if f" {leak} " not in f" {r[1].lower()} "]
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation(), library.no_padding()
    want = {}
    for i, text, *_ in kept:
        hidden = text if "token" not in text else text[: text.index("token")] + "[secret]" + text[text.index("0a" * 20) + 40 :]
        want[i] = (library.encode(hidden, add_special_tokens=False).ids, hashlib.sha256(hidden.encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
    assert bpe.default_tokenizer() and common.UPPER and decontamination.WINDOW == 10
