"""Language-model scoring with Elias-Fano n-gram tries (order 2).

Tokens are the white-space separated words (A-Z lower-cased) and one end for each text. Counts of
training tokens are summed over the whole corpus, and every word has bigrams of its own:

    P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU),  P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

The commonest words (HEAD at most) are broadcast with their counts, the others are rare; which is
which decides only where a count is kept. Bigrams belong to shards: those of two commonest words by the
hash of the bigram, the others by that of their rare word, of the second if both are. The shard of a
rare word thus has all that ends in it and its count, P(w) and, for the word after it, c(v).

Learning counts the bigrams of training texts inside each task, sums them in their shard and writes
each shard's tries once, to the folder the session names for checkpoints: one of bigrams of commonest
words, one of those with a rare word, beside which the words' classes or hashes and the rare words' counts
are kept.
Neither counts nor tries are ever gathered in one place and nothing is pruned; the number of shards grows
with the tokens, and each is a partition of its own. Bigrams of the DENSE commonest words, which
a large part of all texts share, are in a trie of bounded size that is broadcast, so they needn't travel.

Scoring maps a shard's tries and looks up what texts ask. Texts travel in blocks: a block sends each
shard one request, and gets one reply, with a few bytes for each token.

A trie has two levels: for each context the start of its range, a monotone sequence in Elias-Fano
form, and the words of all ranges, made monotone by the context and in Elias-Fano form too, with
one quantised value each: log10(1 + c(v, w) / (MU * P(w))), rounded down to one of LEVELS steps, so
that probabilities never sum to more than 1. The levels lie in one anonymous memory map, without a
file, and a query is a successor search inside its context's range.

Defined cases: a null or wordless text is one end token; without training texts every base count
is 0 and V is 0; repeated rows each count and are scored each; a null doc_id counts as '' for the
hold-out; a text of any length is worked on whole; an empty table gives no rows; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.blocks import mix, ranges, texts, words
from turnlake.llm.common import held_out, table, written

HEAD, DENSE = 1 << 17, 512
MU = 300.0
LEVELS, STEP = 4096, 10 / 4096
#: Bytes of unary between two ranks that are kept.
RANKED = 16
SHARD_TOKENS, FLUSH_TOKENS = 1_200_000, 1_000_000
_WIDTH = 18  # bits of a class id: HEAD, rare and begin; bits of a word in a trie, if not told
_DENSE_WIDTH = 16  # bits of a word in the trie of the commonest bigrams
_U = np.uint64
_END = np.uint64(0x5EEDE4D)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NTH = np.array([[([k for k in range(8) if b >> (7 - k) & 1] + [8] * 8)[i] for i in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence: low bits in an array, high parts in unary, random access by select."""

    def __init__(self, low: np.ndarray, unary: np.ndarray, bits: int):
        self.low, self.unary, self.bits = low, unary, bits
        # how many marks come before each RANKED bytes: half a bit for each of unary
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(_POP[unary], np.arange(0, len(unary), RANKED), dtype=np.int64))])

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, int]:
        bits = max(0, int(math.log2(universe / len(values)))) if len(values) and universe > len(values) else 0
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
        low = (values & ((1 << bits) - 1)).astype(kind)
        high = values >> bits
        marks = np.zeros(int(high[-1]) + len(values) + 1 if len(values) else 1, np.uint8)
        marks[high + np.arange(len(values))] = 1
        return low, np.packbits(marks), bits

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, i, "right") - 1
        byte, rank = block * RANKED, i - self.before[block]
        # the block's bytes one after another, for all places that are still behind theirs
        live = np.arange(len(i))
        while len(live):
            here = _POP[self.unary[byte[live]]]
            live, here = (x[rank[live] >= here] for x in (live, here))
            rank[live] -= here
            byte[live] += 1
        return ((byte * 8 + _NTH[self.unary[byte], rank] - i) << self.bits) | self.low[i].astype(np.int64)


class Trie:
    """Bigrams (context << width | word, sorted, distinct) with values; level files can be memory-mapped."""

    def __init__(self, buffer):
        n, *sizes = np.frombuffer(buffer, np.int64, 9)
        at, arrays = 72, []
        for size, kind in zip(sizes[:5], (sizes[5], 0, sizes[6], 0, 1)):
            t = (np.uint8, np.uint16, np.uint32, np.uint64)[kind]
            arrays.append(np.frombuffer(buffer, t, size, at))
            at += -(-size * np.dtype(t).itemsize // 8) * 8
        self.n, bits = int(n), int(sizes[7])
        self.width = bits >> 16
        self.start = EliasFano(arrays[0], arrays[1], bits >> 8 & 255)
        self.word = EliasFano(arrays[2], arrays[3], bits & 255)
        self.value = arrays[4]

    @staticmethod
    def pack(keys: np.ndarray, values: np.ndarray, contexts: int, width: int = _WIDTH) -> bytes:
        start = np.searchsorted(keys, np.arange(contexts + 1, dtype=np.int64) << width)
        a, b = EliasFano.parts(start, len(keys) + 1), EliasFano.parts(keys, contexts << width)
        kind = lambda x: {1: 0, 2: 1, 4: 2, 8: 3}[x.itemsize]
        arrays = [a[0], a[1], b[0], b[1], values.astype(np.uint16)]
        head = np.array([len(keys), *map(len, arrays), kind(a[0]), kind(b[0]), width << 16 | a[2] << 8 | b[2]], np.int64)
        return head.tobytes() + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 if it isn't there: the successor of its word in the range of its context."""
        out = np.zeros(len(keys), np.int64)
        if not self.n:
            return out
        context = keys >> self.width
        lo, hi = self.start[context], self.start[context + 1]
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.word[mid] < keys[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        at = np.flatnonzero(lo < self.start[context + 1])
        hit = at[self.word[lo[at]] == keys[at]]
        out[hit] = self.value[lo[hit]]
        return out


def _tally(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights, n).astype(float)  # of nothing bincount makes integers


def _mapped(packed: bytes) -> mmap.mmap:
    held = mmap.mmap(-1, len(packed))
    held.write(packed)
    return held


@dataclass
class Vocabulary:
    """What every task needs; its size is bounded by HEAD and DENSE."""

    word: np.ndarray  # hashes of the head words, sorted
    count: np.ndarray
    tokens: int  # N
    kinds: int  # V
    begins: int  # training texts
    dense: np.ndarray | None = None  # class -> id in the trie of the commonest bigrams, -1 if none
    top: bytes = b""  # that trie

    def __post_init__(self):
        self.mass = self.tokens + 0.5 * (self.kinds + 1)
        share = (self.count + 0.5) / self.mass
        self.share = np.append(share, [1.0, 1.0])  # head, rare (whose shards know it), begin
        self.total = np.append(self.count, [0, self.begins]).astype(float)

    @property
    def rare(self) -> int:
        return len(self.word)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, at, self.rare)

    @staticmethod
    def gain(count: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Quantised log10(1 + c / (MU P(w))), in steps, rounded down."""
        return np.minimum(np.log10(1 + count / (MU * share)) / STEP, LEVELS - 1).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the tokens, each text's end after its words."""
    h, row = words(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at = np.cumsum(n)
    return np.insert(h, at, _END), np.insert(row, at, np.arange(len(n)))


def _bigrams(v: Vocabulary, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = v.classes(h)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    context[first] = v.rare + 1
    return context, word


def _summed(parts: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(weights) if weights else None, len(keys)).astype(np.int64)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From docs (text, train): unigram counts, then the trie of the commonest bigrams, each a pass with map-side sums."""

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        n = 0
        for batch in batches:
            data, offsets = texts(batch)
            for i, j in ranges(offsets):
                found.append(_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
                n += len(found[-1])
                if n >= FLUSH_TOKENS:
                    keys, c = _summed(found)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], names=["h", "c"])
                    found, n = [], 0
        if found:
            keys, c = _summed(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], names=["h", "c"])

    train = docs.where("train").select("text")
    counts = written(train.mapInArrow(unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    # the least count that HEAD words at most reach, from a histogram of eighths of powers of 2
    rung = F.floor(F.log2("c") * 8)
    steps = sorted((r.rung, r.least, r.n, r.total) for r in counts.groupBy(rung.alias("rung")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("c").alias("total")).collect())
    least, room = None, HEAD
    for _, low, n, _ in reversed(steps):
        room -= n
        if room < 0:
            break
        least = low
    head = counts.where(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    word, count = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(word)
    ends = counts.where(F.col("h") == int(_END)).first()
    v = Vocabulary(word[order], count[order], sum(s[3] for s in steps), sum(s[2] for s in steps), ends.c if ends else 0)

    dense = np.full(len(v.word) + 2, -1, np.int64)
    top = np.sort(np.argsort(-v.count, kind="stable")[: DENSE - 2])
    picked = np.append(top, v.rare + 1)
    dense[picked] = np.arange(len(picked))
    sent = docs.sparkSession.sparkContext.broadcast((v, dense))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to = sent.value
        total = np.zeros(DENSE * DENSE, np.int64)
        for batch in batches:
            data, offsets = texts(batch)
            for i, j in ranges(offsets):
                context, w = _bigrams(own, *_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                a, b = to[context], to[w]
                total += np.bincount((a * DENSE + b)[(a >= 0) & (b >= 0)], minlength=DENSE * DENSE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "c"])

    got = train.mapInArrow(pairs, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    order = np.argsort(got["pair"].to_numpy())
    pair, count = got["pair"].to_numpy()[order].astype(np.int64), got["c"].to_numpy()[order]
    a, b = pair // DENSE, pair % DENSE
    v.dense, v.top = dense, Trie.pack(a << _DENSE_WIDTH | b, v.gain(count, v.share[picked[b]]), DENSE, _DENSE_WIDTH)
    return v


def shards_for(docs: DataFrame, v: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> int:
    """Shards of about so many tokens of all texts to score."""
    share = docs.agg(F.count(F.lit(1)).alias("all"), F.count_if("train").alias("train")).first()
    return max(1, math.ceil(v.tokens * share["all"] / max(share["train"], 1) / shard_tokens))


def _home(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix(x) % _U(shards)).astype(np.int64)


#: The kinds of bigrams that travel: how context and word are told (a class, or the hash of a rare word), and by which the shard is.
_KINDS = (("pair", None, None), ("headed", np.uint32, np.uint64), ("both", np.uint64, np.uint64), ("after", np.uint64, np.uint32))


def _split(v: Vocabulary, h: np.ndarray, context: np.ndarray, w: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The bigrams of a block that aren't in the broadcast trie: for each of _KINDS where they are, context, word and shard. A pair is one number."""
    known, late = w < v.rare, context == v.rare
    plain = np.flatnonzero(known & ~late & ((v.dense[context] < 0) | (v.dense[w] < 0)))
    pair = context[plain] << _WIDTH | w[plain]
    headed, both, after = np.flatnonzero(~known & ~late), np.flatnonzero(~known & late), np.flatnonzero(known & late)
    return [
        (plain, pair, np.zeros(len(pair), np.uint8), _home(pair.view(np.uint64), shards)),
        (headed, context[headed].astype(np.uint32), h[headed], _home(h[headed] + _U(3), shards)),
        (both, h[both - 1], h[both], _home(h[both] + _U(3), shards)),
        (after, h[after - 1], w[after].astype(np.uint32), _home(h[after - 1] + _U(3), shards)),
    ]


def _counted(a: np.ndarray, b: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (a, b) of each shard by shard, those that come more than once first, and how often they come."""
    order = np.lexsort((b, a))
    a, b, home = a[order], b[order], home[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    a, b, home, c = a[first], b[first], home[first], np.diff(np.append(first, len(new)))
    order = np.lexsort((c == 1, home))
    return a[order], b[order], home[order], c[order]


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n lowest bytes of whole numbers, all lowest ones first: higher ones that are alike compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).reshape(-1)


def _unplaned(planes: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros((len(planes) // n, 8), np.uint8)
    wide[:, :n] = planes.reshape(n, -1).T
    return wide.reshape(-1).view("<u8").astype(np.int64)


def _stepped(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers that mostly rise, as the planes of their steps."""
    return _planes(np.diff(x.astype(np.int64), prepend=0) & ((1 << 8 * n) - 1), n)


def _unstepped(planes: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(planes, n)) & ((1 << 8 * n) - 1)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another behind their lengths."""
    return np.array([len(x) for x in arrays], np.int32).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpacked(packed: bytes, kinds: list[type]) -> list[np.ndarray]:
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(packed, np.int32, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(packed, kind, n, at))
        at += out[-1].nbytes
    return out


def _set(classes: np.ndarray) -> bytes:
    """Classes as a bit map: HEAD bits at most, however many there are."""
    bits = np.zeros(int(classes[-1]) + 1 if len(classes) else 0, np.uint8)
    bits[classes] = 1
    return np.packbits(bits).tobytes()


def _row_kind(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.uint32


def _place(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked name is among sorted names, and whether it is there."""
    at = np.minimum(np.searchsorted(names, asked), max(len(names) - 1, 0))
    return at, names[at] == asked if len(names) else np.zeros(len(asked), bool)


def learn(docs: DataFrame, v: Vocabulary, shards: int) -> DataFrame:
    """The tries of the training texts of docs (text, train): a shard and the binaries of _LEVELS a row."""
    sent = docs.sparkSession.sparkContext.broadcast(v)
    names = [f"{k}_{x}" for k, *_ in _KINDS for x in "abc"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held: list[list[tuple]] = []
        n = 0

        def told() -> Iterator[pa.RecordBatch]:
            kinds = [_counted(*(np.concatenate([x[k][f] for x in held]) for f in (1, 2, 3))) for k in range(len(_KINDS))] if held else []
            ids = np.unique(np.concatenate([x[2] for x in kinds])) if held else np.zeros(0, np.int64)
            cols = []
            for (name, *_), (a, b, home, c) in zip(_KINDS, kinds):
                told_a, told_b = (lambda x: _stepped(x, 5), lambda x: x[:0]) if name == "pair" else (lambda x: x, lambda x: x)
                cut = list(zip(np.searchsorted(home, ids), np.searchsorted(home, ids, "right")))
                often = np.append(0, np.cumsum(c > 1))
                cols += [[told_a(a[i:j]).tobytes() for i, j in cut], [told_b(b[i:j]).tobytes() for i, j in cut], [c[i : i + often[j] - often[i]].astype(np.uint32).tobytes() for i, j in cut]]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(x, pa.binary()) for x in cols or [[]] * len(names))], names=["shard", *names])

        for batch in batches:
            data, offsets = texts(batch)
            for i, j in ranges(offsets, 1 << 20):
                h, row = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(_split(own, h, *_bigrams(own, h, row), shards))
                n += len(h)
                if n >= FLUSH_TOKENS:
                    yield from told()
                    n = 0
        yield from told()

    def build(rows: pa.Table) -> pa.Table:
        own = sent.value

        def read(kind: str, a_type: type, b_type: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = (np.frombuffer(b"".join(rows[f"{kind}_{x}"].to_pylist()), t) for x, t in (("a", a_type), ("b", b_type)))
            c, at = np.ones(len(a), np.int64), 0
            for one, often in zip(rows[f"{kind}_a"].to_pylist(), rows[f"{kind}_c"].to_pylist()):
                c[at : at + len(often) // 4] = np.frombuffer(often, np.uint32)
                at += len(one) // np.dtype(a_type).itemsize
            return a, b, c

        pair, c = _summed([np.concatenate([_unstepped(np.frombuffer(x, np.uint8), 5) for x in rows["pair_a"].to_pylist()])], [read("pair", np.dtype("V5"), np.uint8)[2]])
        plain = Trie.pack(pair, own.gain(c, own.share[pair & ((1 << _WIDTH) - 1)]), len(own.word) + 2, _WIDTH)
        (ha, hb, hc), (ba, bb, bc), (aa, ab, ac) = (read(*k) for k in _KINDS[1:])
        # contexts and words: the commonest ones by their class, then the rare ones by their hash
        (heads, i), (rares, j) = np.unique(ha, return_inverse=True), np.unique(np.concatenate([ba, aa]), return_inverse=True)
        context = np.concatenate([i, j + len(heads)])
        (common, i), (rare, j) = np.unique(ab, return_inverse=True), np.unique(np.concatenate([hb, bb]), return_inverse=True)
        word = np.concatenate([j + len(common), i])
        width = max((len(common) + len(rare)).bit_length(), 1)
        key, c = _summed([context << width | word], [np.concatenate([hc, bc, ac])])
        of = key & ((1 << width) - 1)
        # a rare word that ends in this shard has all its bigrams here
        uses = np.bincount(of, c, len(common) + len(rare))[len(common) :]
        share = np.concatenate([own.share[common], (uses + 0.5) / own.mass])
        mixed = Trie.pack(key, own.gain(c, share[of]), max(len(heads) + len(rares), 1), width)
        cols = [plain, mixed, _set(heads), rares.tobytes(), _set(common), rare.tobytes(), _planes(uses, 8).tobytes()]
        return pa.table([pa.array([rows["shard"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in cols)], names=["shard", *_LEVELS])

    counted = docs.where("train").select("text").mapInArrow(count, "shard int, " + ", ".join(f"{x} binary" for x in names))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(counted.repartitionById(parts, F.col("shard")).groupBy("shard").applyInArrow(build, "shard int, " + ", ".join(f"{x} binary" for x in _LEVELS)))


_LEVELS = ("plain", "mixed", "heads", "rares", "common", "rare", "counts")


@dataclass
class _Levels:
    """A shard's tries, mapped, and the names of their contexts and words."""

    plain: Trie
    mixed: Trie
    heads: np.ndarray
    rares: np.ndarray
    common: np.ndarray
    rare: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(row: pd.DataFrame) -> _Levels:
        if not len(row):  # no training text has anything of this shard
            none = Trie(_mapped(Trie.pack(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)))
            return _Levels(none, none, *(np.zeros(0, t) for t in (np.uint32, np.uint64, np.uint32, np.uint64, np.int64)))
        tries = (Trie(_mapped(row[x].iloc[0])) for x in _LEVELS[:2])
        classes = lambda x: np.flatnonzero(np.unpackbits(np.frombuffer(row[x].iloc[0], np.uint8))).astype(np.uint32)
        plain = lambda x, t: np.frombuffer(row[x].iloc[0], t)
        return _Levels(*tries, classes("heads"), plain("rares", np.uint64), classes("common"), plain("rare", np.uint64), _unplaned(plain("counts", np.uint8), 8))

    def gains(self, kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The steps that each bigram of a kind gains; each distinct one is looked up once."""
        if kind == "pair":
            trie, key, found = self.plain, a, np.ones(len(a), bool)
        else:
            (i, here), (j, there) = _place(self.heads if kind == "headed" else self.rares, a), _place(self.common if kind == "after" else self.rare, b)
            trie, found = self.mixed, here & there
            key = (i + (0 if kind == "headed" else len(self.heads))) << trie.width | (j + (0 if kind == "after" else len(self.common)))
        out = np.zeros(len(key), np.int32)
        key, which = np.unique(key[found], return_inverse=True)
        out[found] = trie.find(key)[which]
        return out


def score(docs: DataFrame, v: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score for each row of docs (doc_id, text, train)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = shards_for(docs, v, shard_tokens)
    tries = learn(docs, v, shards)
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        logs, totals = np.log10(own.share), np.log10(own.total + MU)
        logs[own.rare] = totals[own.rare] = 0  # the shards of rare words know theirs
        top = Trie(_mapped(own.top))
        for batch in batches:
            data, offsets = texts(batch)
            rows = batch.column(2).to_numpy()
            train = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in ranges(offsets, 4 << 20):
                h, row = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                context, w = _bigrams(own, h, row)
                n, known = j - i, w < own.rare
                base = _tally(row, np.where(known, logs[w], 0), n)
                lm = _tally(row, math.log10(MU) + logs[w] - totals[context], n)
                a, b = own.dense[context], own.dense[w]
                table = (a >= 0) & (b >= 0)
                key, which = np.unique(a[table] << _DENSE_WIDTH | b[table], return_inverse=True)
                lm += _tally(row[table], top.find(key)[which] * STEP, n)
                place = row
                split = _split(own, h, context, w, shards)
                order = [np.argsort(x[3], kind="stable") for x in split]
                home = int(_home(np.array([rows[i]], np.uint64), shards)[0])
                # only the shards that this block has something for, however many there are
                asked = np.unique(np.concatenate([*(x[3] for x in split), [home]]))
                cut = [[np.searchsorted(x[3][o], asked, side) for side in ("left", "right")] for x, o in zip(split, order)]
                cols = [(a[o], b[o], place[at][o]) for (at, a, b, _), o in zip(split, order)]
                out = []
                for k, s in enumerate(asked.tolist()):
                    full = [train[i:j], np.bincount(row, minlength=n), np.bincount(row[known], minlength=n), base, lm] if s == home else None
                    parts = [x[c[0][k] : c[1][k]] for col, c in zip(cols, cut) for x in col]
                    body = _packed([_planes(parts[0], 5), *(_stepped(x, 3) if i % 3 == 2 else x for i, x in enumerate(parts) if i > 1)])
                    out.append((s, int(rows[i]), n, body, _packed(full) if full else b"", full is not None))
                offset = np.cumsum([0, *(n if o[5] else 0 for o in out)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offset), batch.column(0).slice(i, n))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))] + [ids], names=["shard", "block", "n", "body", "full", "ids"])

    def answer(pdf: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        """For each block's request the gains of its bigrams, in steps, and the unigram logs of its rare words."""
        own = sent.value
        if not len(pdf):
            return pdf
        held = _Levels.of(levels)
        kinds = [np.uint8, np.uint8, *(t for _, a, b in _KINDS[1:] for t in (a, b, np.uint8))]
        asked = [_unpacked(x, kinds) for x in pdf.pop("body")]
        bodies = [[(_unplaned(x[0], 5), x[0], _unstepped(x[1], 3)), *((a, b, _unstepped(c, 3)) for a, b, c in zip(x[2::3], x[3::3], x[4::3]))] for x in asked]
        every = lambda k, f: np.concatenate([b[k][f] for b in bodies])
        steps = [held.gains(name, every(k, 0), every(k, 1)) for k, (name, *_) in enumerate(_KINDS)]
        cut = [np.cumsum([0, *(len(b[k][0]) for b in bodies)]) for k in range(len(_KINDS))]
        # of the rare words that are asked for here: the second of the kinds headed and both
        rare, use = np.unique(np.concatenate([every(1, 1), every(2, 1)]), return_inverse=True)
        at, there = _place(held.rare, rare)
        count = np.zeros(len(rare))
        count[there] = held.counts[at[there]]
        log = np.log10((count + 0.5) / own.mass)
        # beside log10 P(w): what the word is as a context
        added = log - np.where(rare == _END, 0, np.log10(count + MU))
        log, there, added = log[use], there[use], added[use]
        shift, replies = int(cut[1][-1]), []
        for k, body in enumerate(bodies):
            row, i = np.unique(np.concatenate([x[2] for x in body]), return_inverse=True)
            gained = _tally(i, np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(steps, cut)]), len(row)).astype(np.int32)
            y = np.concatenate([np.arange(cut[1][k], cut[1][k + 1]), shift + np.arange(cut[2][k], cut[2][k + 1])])
            other, i = np.unique(np.concatenate([body[1][2], body[2][2]]), return_inverse=True)
            told = [_tally(i, x[y], len(other)) for x in (log, added, there)]
            at = _row_kind(pdf["n"].iloc[k])
            replies.append(_packed([row[gained > 0].astype(at), gained[gained > 0], other.astype(at), told[0], told[1], told[2].astype(np.uint32)]))
        return pdf.assign(body=replies)[["shard", "block", "n", "body", "full", "ids"]]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        """The replies to one block, summed in the order of the shards."""
        n = int(pdf["n"].iloc[0])
        base, lm, known, train, tokens, doc = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64), []
        at = _row_kind(n)
        for body, full, ids in pdf.sort_values("shard")[["body", "full", "ids"]].itertuples(index=False):
            row, gained, other, log, added, there = _unpacked(body, [at, np.int32, at, np.float64, np.float64, np.uint32])
            lm[row] += gained * STEP
            base[other] += log
            lm[other] += added
            known[other] += there
            if full:
                told = _unpacked(full, [np.int64, np.int64, np.int64, np.float64, np.float64])
                train, tokens, doc = told[0] > 0, told[1], list(ids)
                known += told[2]
                base += told[3]
                lm += told[4]
        # whole numbers with gaps would turn into floats
        doc = pd.array(doc, "Int64") if kind in ("bigint", "int", "smallint", "tinyint") else doc
        return pd.DataFrame({"doc_id": doc, "train": train, "n_tokens": tokens, "n_known": known, "base_score": base.round(8), "score": lm.round(8)})

    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), "train")
    kinds = f"shard int, block long, n int, body binary, full binary, ids array<{kind}>"
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = keyed.mapInArrow(route, kinds).repartitionById(parts, F.col("shard"))
    replies = asked.groupBy("shard").cogroup(tries.repartitionById(parts, F.col("shard")).groupBy("shard")).applyInPandas(answer, kinds)
    return replies.groupBy("block").applyInPandas(combine, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(5, 1)).alias("train"))
    v = vocabulary(docs)
    scored = score(docs, v)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
