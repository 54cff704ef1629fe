"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The corpus' most frequent words, with the ids that the tokenizer gives them,
are compiled into a minimal acyclic automaton: common prefixes and common
suffixes are stored once, and outputs on the arcs add up to a word's number,
which names its row of ids. The compiled lexicon is a flat byte string of
bounded size (`words`); it is broadcast, and each task maps it into memory.

Texts are read some BLOCK bytes at a time, as whole arrays: words are cut by the
kinds of neighbouring characters, all words of a block walk the transducer side
by side, byte after byte, and the words that it lacks are merged side by side by
the tokenizer's ranks, join after join. Nothing is remembered from one block to
the next, so memory does not depend on how many words a task meets.

The tokenizer's file is a parameter; it is read, never trained.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

# Fixed value: how a byte-level tokenizer of this kind cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 64
BLOCK = 1 << 18  # bytes of texts that are encoded at a time; a longer text by itself
WIDTHS = (8, 16, 32, 64)  # words up to so many bytes are merged side by side, each in a row of that width
HELD_WORDS = 150_000
ID_BITS = 24
NO_JOIN = 1 << 62
SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)  # kinds of characters; BLANK is white space but for the plain space
# What is cut off behind an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def added_pattern(added: Iterable[str]) -> regex.Pattern | None:
    """What finds added tokens in a text, the longer ones first; None without any."""
    return regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None


class Tokenizer:
    """Vocabulary, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, source: str):
        data = json.loads(source)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.bytes = [self.ids.get(bytes([b]), -1) for b in range(256)]
        # Both ids to the rank and the joined id: the least value is the least rank.
        self.joins = {self.ids[a] << ID_BITS | self.ids[b]: i << ID_BITS | self.ids[a + b] for i, (a, b) in enumerate((raw(a), raw(b)) for a, b in merges)}
        self.pieces: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: the neighbours of least rank are joined, leftmost first, until none has a rank."""
        return merge_long([self.bytes[b] for b in word], self.joins)


def parts_of(text: str, special: regex.Pattern | None, added: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """The text around added tokens, and the added tokens with their ids."""
    at = 0
    for m in special.finditer(text) if special else ():
        yield text[at : m.start()], None
        yield m[0], added[m[0]]
        at = m.end()
    yield text[at:], None


def merge_long(part: list[int | None], joins: dict[int, int]) -> tuple[int, ...]:
    """Tokenizer.merge of a word as ids of its bytes, by a heap of joins: in time that its length bounds but for a logarithm."""
    n, join = len(part), joins.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := join(part[i] << ID_BITS | part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if part[i] is None or (j := after[i]) >= n or join(part[i] << ID_BITS | part[j]) != r:
            continue  # one of the two has been joined to another meanwhile
        part[i], part[j] = r & (1 << ID_BITS) - 1, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := join(part[i] << ID_BITS | part[after[j]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := join(part[before[i]] << ID_BITS | part[i])) is not None:
            heapq.heappush(heap, (r, before[i]))
    return tuple(i for i in part if i is not None)


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal acyclic transducer of (word, ids), as flat bytes.

    Words are added in byte order; once the next word leaves a state, the state is final and is
    replaced by an equal one if there is one. Layout: seven counts, then the arrays of Lexicon.
    """
    entries = sorted(dict(entries).items())
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]  # open states along the last word: is it an end, its settled arcs
    last = b""
    for word, _ in entries:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) > same + 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = settle(path[0])
    below = [0] * len(states)  # words that end at or after a state; arcs lead to states settled earlier
    for s, (end, arcs) in enumerate(states):
        below[s] = end + sum(below[t] for _, t in arcs)
    first, label, target, output = [0], bytearray(), [], []
    for end, arcs in states:
        passed = int(end)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            output.append(passed)
            passed += below[t]
        first.append(len(target))
    lens = [0, *itertools.accumulate(len(ids) for _, ids in entries)]
    arrays = [
        np.array(first, "<u4"), np.array([s[0] for s in states], "u1"), np.frombuffer(bytes(label), "u1"), np.array(target, "<u4"),
        np.array(output, "<u4"), np.array(lens, "<u4"), np.array([i for _, ids in entries for i in ids], "<u4"),
    ]
    head = np.array([root, *map(len, arrays)], "<u8")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file of the task's own that goes with the task."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        root, *sizes = np.frombuffer(self.map, "<u8", 8).tolist()
        at, kinds, arrays = 64, ("<u4", "u1", "u1", "<u4", "<u4", "<u4", "<u4"), []
        for n, kind in zip(sizes, kinds):
            step = np.dtype(kind).itemsize
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += n * step
        self.root, self.states = root, sizes[1]
        first, self.end, labels, self.target, self.output, self.lens, self.rows = arrays
        self.arcs = np.append(np.repeat(np.arange(self.states), np.diff(first.astype(np.int64))) << 8 | labels, -1)[: len(labels) or 1]

    def find_all(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the words that begin at `start` in `data`; -1 for those that the lexicon lacks.

        All words take their next byte at once; arcs are in order of their states and bytes, so an arc is found by halving.
        """
        out = np.full(len(start), -1, np.int64)
        word = np.flatnonzero(size > 0)
        state = np.full(len(word), self.root, np.int64)
        number = np.zeros(len(word), np.int64)
        step = 0
        while len(word):
            byte = data[start[word] + step]
            key = state << 8 | byte
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            met = np.flatnonzero(self.arcs[arc] == key)
            word, arc = word[met], arc[met]
            number = number[met] + self.output[arc]
            state = self.target[arc].astype(np.int64)
            step += 1
            done = size[word] == step
            if done.any():
                out[word[done]] = np.where(self.end[state[done]] > 0, number[done], -1)
                word, state, number = word[~done], state[~done], number[~done]
        return out

    def find(self, word: bytes) -> tuple[int, ...] | None:
        """The word's ids, or None if the lexicon lacks it."""
        number = int(self.find_all(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if number < 0 else tuple(self.rows[self.lens[number] : self.lens[number + 1]].tolist())


def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((BLANK, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            shift = 0x800 if m.start() >= 0xD800 else 0
            out[m.start() + shift : m.end() + shift] = kind
    out[0x20] = SPACE
    return out


def word_starts(code: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin in texts laid one after the other, each of which begins where `begins` holds.

    `code` has the code points and `kind` their kinds. This is PATTERN, said of neighbours: runs of letters, of numbers,
    of white space and of other characters are words; of white space before another character the last one stands by
    itself, and if it is a plain space it belongs to the word behind it.
    """
    n = len(code)
    run = np.maximum(kind, BLANK)
    start = begins.copy()
    start[1:] |= run[1:] != run[:-1]
    last = np.ones(n, bool)  # the last of its run
    last[:-1] = start[1:]
    ended = np.ones(n, bool)  # the last of its text
    ended[:-1] = begins[1:]
    split = last & ~ended & (run == BLANK)
    start |= split
    glued = np.zeros(n, bool)
    glued[1:] = (split & (kind == SPACE))[:-1]
    start &= ~glued | begins
    # an apostrophe that is a word by itself takes one of the contractions from the letters behind it
    quote = np.flatnonzero((code == 0x27) & start & last & ~ended)
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        following = [np.where(quote + i < n, code[np.minimum(quote + i, n - 1)], 0) for i in (1, 2)]
        inside = (quote + 2 < n) & ~begins[np.minimum(quote + 2, n - 1)]
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            met = following[0] == ord(c[0])
            if len(c) == 2:
                met &= inside & (following[1] == ord(c[1]))
            size[met] = len(c)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        behind = quote + 1 + size
        behind = behind[behind < n]
        start[behind] = True
    return np.flatnonzero(start)


class Cutter:
    """Cuts texts into words."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' bytes one after the other, where words begin in them (and the last ends), and how many words each text has."""
        whole = "".join(texts)
        raw = whole.encode()
        data = np.frombuffer(raw, np.uint8)
        if whole.isascii():
            code, place = data, None
        else:
            code, place = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)
        at = np.cumsum([0, *map(len, texts)])
        begins = np.zeros(len(code), bool)
        begins[at[:-1][at[:-1] < len(code)]] = True
        start = word_starts(code, self.kinds.take(code), begins)
        per = np.diff(np.searchsorted(start, at))
        if place is not None:
            start = place[start]
        return raw, np.append(start, len(raw)), per


class Rules:
    """What encoding and decoding take of a tokenizer, as arrays: it is broadcast, and no task reads the file."""

    def __init__(self, tokenizer: Tokenizer):
        self.added = tokenizer.added
        self.pairs = np.array(sorted(tokenizer.joins), np.int64)
        self.ranks = np.array([tokenizer.joins[p] for p in self.pairs.tolist()], np.int64)
        self.bytes = np.array(tokenizer.bytes, np.int64)
        self.flat, self.edge = b"".join(tokenizer.pieces), np.cumsum([0, *map(len, tokenizer.pieces)])
        self.kinds = kinds()


class Encoder:
    """Encodes texts, many at a time."""

    def __init__(self, rules: Rules, compiled: bytes):
        self.rules, self.lexicon, self.cutter = rules, Lexicon(compiled), Cutter(rules.kinds)
        self.pairs, self.ranks, self.bytes = rules.pairs, rules.ranks, rules.bytes
        self.special = added_pattern(rules.added)
        self.joins: dict[int, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and joined id of neighbouring ids; NO_JOIN where they have none (as where one is -1)."""
        key = a << ID_BITS | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_JOIN)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Words as rows of ids, filled up with -1: in each row the neighbours of least rank are joined, leftmost first, until none has a rank."""
        out = ids.copy()
        row = np.arange(len(ids))
        ranks = np.full(ids.shape, NO_JOIN)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        step = np.arange(ids.shape[1])
        while len(row):
            at = ranks.argmin(axis=1)
            own = np.arange(len(row))
            low = ranks[own, at]
            more = low != NO_JOIN
            if not more.all():
                out[row[~more]] = ids[~more]
                row, ids, ranks, at, low = row[more], ids[more], ranks[more], at[more], low[more]
                own = np.arange(len(row))
                if not len(row):
                    break
            # what is behind the join moves up by one
            move = step > at[:, None]
            ids[:, :-1] = np.where(move[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(move[:, :-1] | (step == at[:, None])[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NO_JOIN
            ids[own, at] = low & (1 << ID_BITS) - 1
            ranks[own, at] = self.rank(ids[own, at], ids[own, np.minimum(at + 1, ids.shape[1] - 1)])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in `data`, one word after the other, and how many each has."""
        count = np.zeros(len(start), np.int64)
        groups = []
        least = 0
        for width in WIDTHS:
            of = np.flatnonzero((size > least) & (size <= width))
            least = width
            for part in (of[i : i + (1 << 16) // width] for i in range(0, len(of), (1 << 16) // width)):
                column = np.arange(width)
                ids = self.bytes[data[np.minimum(start[part, None] + column, len(data) - 1)]]
                ids[column >= size[part, None]] = -1
                ids = self.merge_rows(ids)
                full = ids >= 0
                count[part] = full.sum(axis=1)
                groups.append((part, ids[full]))
        for i in np.flatnonzero(size > least).tolist():
            self.joins = self.joins or dict(zip(self.pairs.tolist(), self.ranks.tolist()))
            ids = np.array(merge_long(self.bytes[data[start[i] : start[i] + size[i]]].tolist(), self.joins), np.int64)
            count[i] = len(ids)
            groups.append((np.array([i]), ids))
        out = np.zeros(count.sum(), np.int64)
        begin = np.cumsum(count) - count
        for of, ids in groups:
            out[common.ragged(begin[of], count[of])] = ids
        return out, count

    def words(self, raw: bytes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words between the places `edge`, one word after the other, and how many each has."""
        data = np.frombuffer(raw, np.uint8)
        start, size = edge[:-1], np.diff(edge)
        number = self.lexicon.find_all(data, start, size)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        count = np.zeros(len(start), np.int64)
        lens = self.lexicon.lens
        first = lens[number[known]].astype(np.int64)
        count[known] = lens[number[known] + 1] - first
        # unseen words that occur more than once in the block are merged once
        spelt = [raw[a:b] for a, b in zip(start[new].tolist(), edge[new + 1].tolist())]
        seat = {w: i for i, w in enumerate(dict.fromkeys(spelt))}
        which = np.fromiter(map(seat.__getitem__, spelt), np.int64, len(spelt))
        sample = np.zeros(len(seat), np.int64)
        sample[which] = new
        ids, n = self.merged(data, start[sample], size[sample])
        count[new] = n[which]
        begin = np.cumsum(count) - count
        out = np.zeros(count.sum(), np.int32)
        out[common.ragged(begin[known], count[known])] = self.lexicon.rows[common.ragged(first, count[known])]
        out[common.ragged(begin[new], count[new])] = ids[common.ragged((np.cumsum(n) - n)[which], count[new])]
        return out, count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text after the other, and how many each has."""
        parts, of, specials = [], [], []
        for i, text in enumerate(texts):
            for part, special in parts_of(text or "", self.special, self.rules.added):
                of.append(i)
                parts.append("" if special is not None else part)
                specials.append(-1 if special is None else special)
        raw, edge, per = self.cutter.cut(parts)
        ids, count = self.words(raw, edge)
        ends = np.concatenate([[0], np.cumsum(count)])
        word = np.concatenate([[0], np.cumsum(per)])
        n = ends[word[1:]] - ends[word[:-1]]
        specials, of = np.array(specials, np.int64), np.array(of, np.int64)
        own = specials >= 0
        if own.any():  # an added token stands between the parts of its text
            ids = np.insert(ids, (np.cumsum(n))[own], specials[own].astype(np.int32))
            n = n + own
        return ids, np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)


def blocks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts, some BLOCK characters at a time."""
    out: list[str | None] = []
    size = 0
    for text in texts:
        out.append(text)
        size += len(text or "")
        if size >= BLOCK:
            yield out
            out, size = [], 0
    if out:
        yield out


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word, n): how often each word that the tokenizer cuts occurs in all texts, summed within tasks before the shuffle.

    Words are counted that have at most LEXICON_BYTES bytes; longer ones can't be in a lexicon.
    """
    held = docs.sparkSession.sparkContext.broadcast((list(Tokenizer(tokenizer).added), kinds()))

    def make():
        added, table = held.value
        cutter, special = Cutter(table), added_pattern(added)
        counts: dict[bytes, int] = {}

        def flush():
            yield {"word": list(counts), "n": list(counts.values())}
            counts.clear()

        def each(batch):
            for block in blocks(t.as_py() for t in batch.column(0)):
                parts = [p for t in block for p in (special.split(t or "") if special else (t or "",))]
                raw, edge, _ = cutter.cut(parts)
                short = np.flatnonzero(np.diff(edge) <= LEXICON_BYTES)
                for word in map(raw.__getitem__, map(slice, edge[short].tolist(), edge[short + 1].tolist())):
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > HELD_WORDS:
                    yield from flush()

        each.rest = flush
        return each

    return common.map_arrow(docs.select(text), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the `words` most frequent words of all texts (of at most LEXICON_BYTES bytes; equal counts by word)."""
    own = Tokenizer(tokenizer)
    counts = common.written(word_counts(docs, tokenizer, text), "words")
    # Only words at or above the power of two that the last of the frequent ones reaches are ranked: a few rows go to the driver.
    power = F.floor(F.log2("n")).cast("int")
    held, least = 0, 0
    for row in sorted(counts.groupBy(power.alias("power")).agg(F.count("*").alias("held")).collect(), reverse=True):
        held, least = held + row["held"], row["power"]
        if held >= words:
            break
    top = counts.where(F.col("n") >= 1 << least).orderBy(F.col("n").desc(), "word").limit(words).collect()
    return compile_lexicon((raw, own.merge(raw)) for raw in (bytes(r["word"]) for r in top))


def _lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    ends = np.cumsum(np.concatenate([[0], *[n for _, n in found]]), dtype=np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of more ids than Arrow lists can hold; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in found]])))


def _decoded(batch: pa.ListArray, flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    ids = batch.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(edge) - 1):
        raise ValueError("an id that the vocabulary lacks")
    number = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    word = np.concatenate([[0], np.cumsum(number, dtype=np.int64)])
    out: list[str | None] = []
    for i, there in enumerate(batch.is_valid().to_pylist()):
        own = ids[word[i] : word[i + 1]]
        size = edge[own + 1] - edge[own]
        out.append(flat[common.ragged(edge[own], size)].tobytes().decode("utf-8", "replace") if there else None)
    return pa.array(out, type=pa.string())


def encode_column(text: str | Column, tokenizer: str, compiled: bytes, spark: SparkSession) -> Column:
    """The ids of each whole text, as array<int>; empty for a null or empty text."""
    common.ship(spark)
    held = spark.sparkContext.broadcast((Rules(Tokenizer(tokenizer)), compiled))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*held.value)
        for batch in batches:
            yield _lists([encoder.encode(block) for block in blocks(t.as_py() for t in batch)])

    return run(text)


def decode_column(ids: str | Column, tokenizer: str, spark: SparkSession) -> Column:
    """The text of each array of ids; bytes that are no UTF-8 become U+FFFD. Null ids give null; an id that the vocabulary lacks is an error."""
    common.ship(spark)
    rules = Rules(Tokenizer(tokenizer))
    held = spark.sparkContext.broadcast((rules.flat, rules.edge))

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat, edge = np.frombuffer(held.value[0], np.uint8), held.value[1]
        for batch in batches:
            yield _decoded(batch, flat, edge)

    return run(ids)


def round_trip_column(text: str | Column, tokenizer: str, compiled: bytes, spark: SparkSession) -> Column:
    """A struct of each text's ids and of what they decode to: encode_column and decode_column in one pass, and one Python worker."""
    common.ship(spark)
    held = spark.sparkContext.broadcast((Rules(Tokenizer(tokenizer)), compiled))
    kind = common.struct_of("ids array<int>, decoded string")

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*held.value)
        flat, edge = np.frombuffer(held.value[0].flat, np.uint8), held.value[0].edge
        for batch in batches:
            ids = _lists([encoder.encode(block) for block in blocks(t.as_py() for t in batch)])
            yield pa.StructArray.from_arrays([ids, _decoded(ids, flat, edge)], fields=list(to_arrow_type(kind)))

    return run(text)


def default_tokenizer() -> str:
    """The text of the byte-level tokenizer's file that this machine offers."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, ids: Column, decoded: Column) -> DataFrame:
    return docs.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), common.lines_sha256(ids.cast("array<string>")).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """`docs` without other columns than doc_id: its ids, and their text again."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    compiled = lexicon(docs, tokenizer, text)
    found = docs.select("doc_id", round_trip_column(F.col(text), tokenizer, compiled, spark).alias("found"))
    return found.select("doc_id", "found.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their text again, as digests."""
    found = encode_and_decode(common.documents(spark, sf_dir).select("doc_id", "text"))
    return digests(found, F.col("ids"), F.col("decoded"))
