"""BPE of single words and of whole texts, against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers

from billsift.llm import bpe


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    return bpe.Tokenizer(bpe.default_tokenizer()), library


@pytest.mark.parametrize("letters", ["ab", "thein", "aeéñß", "中文字"])
def test_both_ways_to_merge_match_the_library(both, letters):
    own, library = both
    rng = random.Random(5)
    side_by_side = encoder(own, [])
    for n in (1, 2, 3, 7, 8, 9, 20, 63, 64, 65, 3000):
        word = "".join(rng.choices(letters, k=n))
        want = library.encode(word, add_special_tokens=False).ids
        assert list(own.merge(word.encode())) == want
        data = np.frombuffer(word.encode(), np.uint8)
        ids, count = side_by_side.merged(data, np.zeros(1, np.int64), np.array([len(data)]))
        assert ids.tolist() == want and count.tolist() == [len(want)]


HARD = [
    "", "a", " ", "  a", "a  ", "\n\n a", "it's 's 'sa ''s x'S don't'll we've' 're", "'", "a '", "'s", "x''re", " \t\n  b c\u3000", "1 2\u24623a_b", "e\u0301'l\u013a na\u00efve \u4e2d\u6587\u5b57 \U0001f600\U0001f600 x",
    "a\r\n b", "'l", "'ll", "'lx", "'v e", "foo <|endoftext|> bar", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "  x", "'d'd 'm", "x" * 3000, "ab" * 40, "\u00e9" * 33, None,
]


def encoder(own, words):
    return bpe.Encoder(bpe.Rules(own), bpe.compile_lexicon((w, own.merge(w)) for w in words))


@pytest.mark.parametrize("words", [[], [b" the"], [b"a", b" a", b"ab", b"abc", b"x", "\u00e9".encode(), b"'s", b" "]])
def test_texts_match_the_library(both, words):
    own, library = both
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choices("ab 's \n\tt1\u00e9.'lrev\u4e2d", k=rng.randint(1, 60))) for _ in range(500)]
    ids, n = encoder(own, words).encode(texts)
    ids = ids.tolist()
    for text, size in zip(texts, n.tolist()):
        mine, ids = ids[:size], ids[size:]
        assert mine == library.encode(text or "", add_special_tokens=False).ids
    assert not ids


def test_words_are_cut_as_the_pattern_says(both):
    pattern, cutter, rng = regex.compile(bpe.PATTERN), bpe.Cutter(bpe.kinds()), random.Random(3)
    texts = [t or "" for t in HARD] + ["".join(rng.choices("ab 's \n\tt1\u00e9.'lrev\u00a0", k=40)) for _ in range(1000)]
    raw, edge, per = cutter.cut(texts)
    words = iter([raw[a:b].decode() for a, b in zip(edge[:-1], edge[1:])])
    assert [[next(words) for _ in range(n)] for n in per] == [pattern.findall(t) for t in texts]


def test_the_transducer_finds_its_words_only(both):
    own, _ = both
    words = [b"a", b"abc", b"abd", b"xbc", b"xbd", b"", b"zzz"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon((w, own.merge(w)) for w in words))
    assert all(lexicon.find(w) == own.merge(w) for w in words if w)
    assert not any(map(lexicon.find, [b"ab", b"b", b"abcd", b"xb", b"zz", b"q"]))
    assert lexicon.states < 12  # the ends of abc and xbc are one


def test_frequent_words_break_ties_by_word(spark, both):
    docs = spark.createDataFrame([(1, "b a c c <|endoftext|> c"), (2, None), (3, "")], "doc_id long, text string")
    lexicon = bpe.Lexicon(bpe.lexicon(docs, bpe.default_tokenizer(), words=2))
    own, _ = both
    assert [w for w in (b" a", b" b", b" c", b"b", b" ") if lexicon.find(w)] == [b" ", b" c"][::-1]
