"""Language-model scoring with a probabilistic suffix tree.

The tree's states are contexts of up to two words that training texts hold often
and whose next-word distribution diverges enough from that of the context one
word shorter (a likelihood-ratio test with a penalty for each stored word). A
state stores its frequent next words, discounted; what is left goes to the other
words in proportion to the shorter context's distribution, down to the root,
whose distribution is (c + 1) / (N + V + 1). A text's score is the sum over its
tokens of log10 of the probability at the longest suffix that is a state.

Counting. Texts are numbered once, block by block. Blocks then ask for what they
need of the whole corpus and get it back: the counts of their words, of pairs
whose words occur ``LEAST`` times, of triples whose pairs do, and the states of
their contexts. Questions are shuffled by a hash of the n-gram, once for each
block that holds it, answers by block; nothing is kept from the counts but the
absolute least, and neither n-grams nor states meet in the driver or in one
task. One block of those with an n-gram adds it to the sums that decide on its
context's state. So counts, states and scores depend on the corpus alone, not on
how it is cut into blocks. Words and n-grams are told apart by 64-bit hashes.

Defined results: a null text is the empty text: one token, the end. Words are
lower-cased (A-Z only). Texts with a null id don't train and aren't held out.
Rows that repeat both id and text get the same scores; all train. Without
training texts every token is unknown with probability 1. Extra columns are
left out.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, crc_bucket, sliced, written

END = "\n"  # no word holds white space
LEAST = 3
DISCOUNT = 0.5
#: Tokens of a block, and documents for each task of the first pass.
BLOCK, DOCS = 1_000_000, 8_192


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_FOUND = pa.schema([("size", pa.int32()), ("gram", pa.string()), ("count", pa.int64()), ("tokens", pa.int64())])


def _block(ids: _Ids, parts: list[np.ndarray]):
    """All n-grams of a block; number 0 is the end, with which it begins."""
    s = np.concatenate([np.zeros(1, np.int32), *parts]).astype(np.int64)
    parts.clear()
    size, names = len(s) - 1, [w.decode("utf-8", "surrogatepass") for w in ids]
    k = len(names)
    counts = np.bincount(s[1:], minlength=k)
    one = np.flatnonzero(counts)
    yield as_batch(_FOUND, [1] * len(one), [names[i] for i in one], counts[one], [size] + [0] * (len(one) - 1))
    two, at, n_two = np.unique(s[:-1] * k + s[1:], return_inverse=True, return_counts=True)
    yield as_batch(_FOUND, [2] * len(two), [f"{names[c // k]} {names[c % k]}" for c in two.tolist()], n_two, [0] * len(two))
    third = np.flatnonzero(s[1:-1] != 0)
    three, n_three = np.unique(at[third] * k + s[third + 2], return_counts=True)
    yield as_batch(_FOUND, [3] * len(three), [f"{names[two[c // k] // k]} {names[two[c // k] % k]} {names[c % k]}" for c in three.tolist()], n_three, [0] * len(three))


def _candidates(batches):
    """N-grams and counts by name: with Grams and Tree the whole model in one
    process, which tests hold the shuffled one against."""
    ids, parts, size = _Ids({END.encode(): 0}), [], 0
    for batch in sliced(batches, 256):
        for text in batch.column(0).to_pylist():
            words = words_of(text)
            parts.append(np.fromiter((*map(ids.__getitem__, words), 0), np.int32, len(words) + 1))
            size += len(words) + 1
        if size >= 2 * BLOCK:
            half, kept = [], 0
            while kept < BLOCK and len(parts) > 1:
                half.append(parts.pop(0))
                kept += len(half[-1])
            yield from _block(ids, half)
            size -= kept
            used, own = np.unique(np.concatenate([[0], *parts]), return_inverse=True)
            names = list(ids)
            ids = _Ids({names[old]: new for new, old in enumerate(used.tolist())})
            parts = np.split(own[1:].astype(np.int32), np.cumsum([len(p) for p in parts])[:-1])
    if parts:
        yield from _block(ids, parts)


class Grams:
    """Numbers of the common words and n-grams, as sorted codes."""

    def __init__(self, words: list[str], pairs: list[tuple], triples: list[tuple]):
        self.words = [END, *(w for w in words if w != END)]
        self.ids = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(self.words)}
        self.k = k = len(self.words)
        number = self.ids.get
        coded = lambda w: number(w.encode("utf-8", "surrogatepass"), -1)
        two = sorted(a * k + b for a, b in ((coded(x), coded(y)) for x, y in pairs) if a >= 0 and b >= 0)
        self.two = np.array(two, np.int64)
        place = {c: i for i, c in enumerate(two)}
        three = ((place.get(coded(x) * k + coded(y), -1), coded(z)) for x, y, z in triples)
        self.three = np.array(sorted(a * k + b for a, b in three if a >= 0 and b >= 0), np.int64)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """The end, the words (-1: not common) and the end again."""
        get = self.ids.get
        return np.fromiter((0, *(get(w, -1) for w in words), 0), np.int64, len(words) + 2)

    def places(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token after the first: the place of the pair that ends with
        it, and of the triple, or -1."""
        two = _place(self.two, np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] * self.k + s[1:], -1))
        three = np.full(len(two), -1, np.int64)
        if len(two) > 1:
            context = np.where(s[1:-1] != 0, two[:-1], -1)
            three[1:] = _place(self.three, np.where((context >= 0) & (s[2:] >= 0), context * self.k + s[2:], -1))
        return two, three


def _place(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


class Tree:
    """The states' adjustments to the root's log10 probabilities."""

    def __init__(self, grams: Grams, n: int, v: int, counts: list[np.ndarray]):
        self.grams, self.n, self.v = grams, n, v
        self.logs = np.log10(counts[0] + 1.0)
        k, floor = grams.k, math.log10(n + v + 1)
        least = LEAST
        root = 10 ** (self.logs - floor)
        #: by pair and triple: log10 of the state's probability over the root's, nan where not stored
        self.two, self.three = np.full(len(grams.two), np.nan), np.full(len(grams.three), np.nan)
        #: by word and by pair: log10 of the share left to other words, 0 where no state
        self.left_one, self.left_two = np.zeros(k), np.zeros(len(grams.two))
        self.states = 0
        by_word: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(counts[1] >= least).tolist():
            by_word[int(grams.two[i] // k)].append(i)
        p_two: dict[int, float] = {}
        # longer contexts keep their shorter ones as states
        by_pair: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(counts[2] >= least).tolist():
            by_pair[int(grams.three[i] // k)].append(i)
        kept_one = {}
        for u, places in by_word.items():
            c = counts[1][places]
            state = self._state(c, int(counts[0][u]), root[grams.two[places] % k])
            if state:
                kept_one[u] = state
                self.states += 1
                self.left_one[u] = state[1]
                for i, p in zip(places, state[0].tolist()):
                    p_two[i] = p
                    self.two[i] = math.log10(p / root[grams.two[i] % k])
        number = {int(c): i for i, c in enumerate(grams.two)}
        for pair, places in by_pair.items():
            c, middle = counts[2][places], int(grams.two[pair] % k)
            shorter = []
            for i in places:
                w = int(grams.three[i] % k)
                j = number.get(middle * k + w)
                shorter.append(p_two[j] if j in p_two else 10 ** self.left_one[middle] * root[w])
            state = self._state(c, int(counts[1][pair]), np.array(shorter))
            if state:
                self.states += 1
                self.left_two[pair] = state[1]
                for i, p in zip(places, state[0].tolist()):
                    self.three[i] = math.log10(p / root[grams.three[i] % k])

    def _state(self, counts: np.ndarray, total: int, shorter: np.ndarray):
        """Probabilities and what is left (log10), if they diverge enough."""
        p = (counts - DISCOUNT) / total
        rest, others = 1 - p.sum(), 1 - shorter.sum()
        if rest <= 0 or others <= 0:
            return None
        left = math.log(rest / others)
        gain = float((counts * np.log(p / shorter)).sum()) + (total - int(counts.sum())) * left
        if gain < 0.5 * len(counts) * math.log(self.n):
            return None
        return p, left / math.log(10)

    def score(self, words: list[bytes]) -> tuple[int, float, float]:
        """Common tokens, their log10(c + 1) summed, and what states add."""
        s = self.grams.numbered(words)
        two, three = self.grams.places(s)
        own = s[1:]
        common = own >= 0
        stored = np.where(two >= 0, self.two[two] if len(self.two) else np.nan, np.nan)
        one = np.where(np.isnan(stored), np.where(s[:-1] >= 0, self.left_one[s[:-1]], 0.0), stored)
        stored = np.where(three >= 0, self.three[three] if len(self.three) else np.nan, np.nan)
        context = np.full(len(own), -1, np.int64)
        if len(own) > 1:
            context[1:] = np.where(s[1:-1] != 0, two[:-1], -1)
        left = np.where(context >= 0, self.left_two[context] if len(self.left_two) else 0.0, 0.0)
        return int(common.sum()), float(self.logs[own[common]].sum()), float(np.where(np.isnan(stored), one + left, stored).sum())


#: Blocks, questions and answers. Kinds: 0 the block, 1 to 3 counts of words,
#: pairs and triples, 4 and 5 states of words and pairs. n: training tokens of a
#: block, words met in training in the first answer of a part.
_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("n", pa.int64())])
_ROWS = "block long, part int, kind int, data binary, n long"


def _packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the upper ones are mostly 0."""
    return zstandard.compress(values.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _blocks(batches):
    """Documents as numbered blocks; number 0 is the end."""
    first = TaskContext.get().partitionId() << 32
    ids, parts, docs, size = _Ids({END.encode(): 0}), [], [], 0

    def block(number: int):
        lengths = np.array([len(p) for p in parts], np.int32)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        tokens = int(lengths[[d[2] for d in docs]].sum())
        data = pickle.dumps((_packed(np.concatenate(parts)), lengths, hashes, docs), 5)
        return as_batch(_ROW, [number], [0], [0], [data], [tokens])

    for batch in sliced(batches, 256):
        for *doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            parts.append(np.fromiter((*map(ids.__getitem__, words), 0), np.int32, len(words) + 1))
            docs.append(doc)
            size += len(words) + 1
            if size >= BLOCK:
                yield block(first)
                ids, parts, docs, size, first = _Ids({END.encode(): 0}), [], [], 0, first + 1
    if parts:
        yield block(first)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes; their order counts."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _View:
    """A block and the answers it has got so far."""

    def __init__(self, rows: pa.Table, parts: int, n: int, v: int):
        self.parts, self.n, self.v, self.block = parts, n, v, rows.column("block")[0].as_py()
        self.answers: dict[int, list] = defaultdict(list)
        for kind, part, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "part", "data"))):
            self.answers[kind].append((part, data))
        tokens, self.lengths, self.words, self.docs = pickle.loads(self.answers.pop(0)[0][1])
        self.s = np.concatenate([np.zeros(1, np.int64), _unpacked(tokens, np.int32)])
        self.k = len(self.words)
        #: by token: whether it trains
        self.trains = np.repeat(np.array([d[2] for d in self.docs], np.float64), self.lengths)

    def ask(self, kind: int, keys: np.ndarray, values: np.ndarray):
        """The questions for each part, by ranges of keys; values have the keys'
        order in their last axis."""
        order = np.argsort(keys)
        own = (keys[order] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)
        ends = np.searchsorted(own, np.arange(self.parts + 1, dtype=np.uint64))
        for part in range(self.parts):
            if len(at := order[ends[part] : ends[part + 1]]):
                steps = np.diff(keys[at], prepend=np.uint64(0))
                # contexts mostly ask for their state without adding to its sums
                some = np.flatnonzero(values[3, at]).astype(np.int32) if kind > 3 else np.zeros(0, np.int32)
                sums = values[:, at[some]] if kind > 3 else values[at]
                yield as_batch(_ROW, [self.block], [part], [kind], [pickle.dumps((_packed(steps), _packed(some), _packed(sums)), 5)], [0])

    def answered(self, kind: int, keys: np.ndarray, dtype) -> np.ndarray:
        """What came back, in the keys' order."""
        out = np.empty(len(keys), dtype)
        if len(keys):
            out[np.argsort(keys)] = np.concatenate([_unpacked(d, dtype) for _, d in sorted(self.answers.pop(kind))])
        return out

    def take_words(self) -> None:
        self.c1 = self.answered(1, self.words, np.int64) >> 1
        self.root = (self.c1 + 1) / (self.n + self.v + 1)

    def find_pairs(self) -> None:
        s, often = self.s, self.c1 >= LEAST
        both = np.flatnonzero(often[s[:-1]] & often[s[1:]])
        self.two, place = np.unique(s[both] * self.k + s[both + 1], return_inverse=True)
        self.n2 = np.bincount(place, self.trains[both], len(self.two)).astype(np.int32)
        self.at2 = np.full(len(s) - 1, -1, np.int64)
        self.at2[both] = place
        self.keys2 = _mixed(self.words[self.two // self.k], self.words[self.two % self.k])

    def take_pairs(self) -> None:
        """Only those that occur often enough stay."""
        got = self.answered(2, self.keys2, np.int64)
        stay = got >> 1 >= LEAST
        new = np.append(np.where(stay, np.cumsum(stay) - 1, -1), -1)
        self.at2, self.two, self.keys2 = new[self.at2], self.two[stay], self.keys2[stay]
        self.c2, self.own2 = got[stay] >> 1, (got[stay] & 1).astype(bool)
        self.one = np.flatnonzero(self.c1 >= LEAST)

    def find_triples(self) -> None:
        s, at2 = self.s, self.at2
        self.third = np.flatnonzero((at2[:-1] >= 0) & (at2[1:] >= 0) & (s[1:-1] != 0))
        self.three, self.at3 = np.unique(at2[self.third] * self.k + s[self.third + 2], return_inverse=True)
        self.n3 = np.bincount(self.at3, self.trains[self.third + 1], len(self.three)).astype(np.int32)
        self.keys3 = _mixed(self.keys2[self.three // self.k], self.words[self.three % self.k])

    def take_triples(self) -> None:
        got = self.answered(3, self.keys3, np.int64)
        self.c3, self.own3 = got >> 1, (got & 1).astype(bool)
        #: by word: natural log of the share left to other words, nan where no state
        self.left1 = np.full(self.k, np.nan)
        self.left1[self.one] = self.answered(4, self.words[self.one], np.float64)
        self.pairs = np.unique(self.at2[:-1][(self.at2[:-1] >= 0) & (self.s[1:-1] != 0)])

    def take_states(self) -> None:
        self.left2 = np.full(len(self.two), np.nan)
        self.left2[self.pairs] = self.answered(5, self.keys2[self.pairs], np.float64)

    @staticmethod
    def _sums(contexts, of, counts, shorter, totals, size):
        """What decides on the states of ``contexts``, summed over own n-grams."""
        terms = (counts * np.log((counts - DISCOUNT) / shorter), counts, shorter, np.ones(len(of)))
        return np.stack([*(np.bincount(of, t, size)[contexts] for t in terms), totals[contexts].astype(np.float64)])

    def questions(self, step: int):
        if step == 1:
            yield from self.ask(1, self.words, np.bincount(self.s[1:], self.trains, self.k).astype(np.int32))
            return
        self.take_words()
        self.find_pairs()
        if step == 2:
            yield from self.ask(2, self.keys2, self.n2)
            return
        self.take_pairs()
        self.find_triples()
        if step == 3:
            yield from self.ask(3, self.keys3, self.n3)
            own = np.flatnonzero(self.own2)
            sums = self._sums(self.one, self.two[own] // self.k, self.c2[own], self.root[self.two[own] % self.k], self.c1, self.k)
            yield from self.ask(4, self.words[self.one], sums)
            return
        self.take_triples()
        if step == 4:
            own = np.flatnonzero(self.own3 & (self.c3 >= LEAST))
            pair, word = self.three[own] // self.k, self.three[own] % self.k
            middle = self.two[pair] % self.k
            inner = np.searchsorted(self.two, middle * self.k + word)
            shorter = np.where(np.isnan(self.left1[middle]), self.root[word], (self.c2[inner] - DISCOUNT) / self.c1[middle])
            yield from self.ask(5, self.keys2[self.pairs], self._sums(self.pairs, pair, self.c3[own], shorter, self.c2, len(self.two)))
            return
        self.take_states()
        yield self.scores()

    def scores(self) -> pa.RecordBatch:
        s, at2 = self.s, self.at2
        own, base = s[1:], np.log10(self.root)
        left = np.nan_to_num(self.left1)[s[:-1]]
        stored = (at2 >= 0) & ~np.isnan(self.left1[s[:-1]])
        added = np.where(stored, 0.0, left / math.log(10))
        added[stored] = np.log10((self.c2[at2[stored]] - DISCOUNT) / self.c1[s[:-1][stored]]) - base[own[stored]]
        context = np.full(len(own), -1, np.int64)
        context[1:] = np.where(s[1:-1] != 0, at2[:-1], -1)
        state = np.flatnonzero(context >= 0)
        state = state[~np.isnan(self.left2[context[state]])]
        c3 = np.zeros(len(own), np.int64)
        c3[self.third + 1] = self.c3[self.at3]
        longer = c3[state] >= LEAST
        added[state[~longer]] += self.left2[context[state[~longer]]] / math.log(10)
        full = state[longer]
        added[full] = np.log10((c3[full] - DISCOUNT) / self.c2[context[full]]) - base[own[full]]
        doc, n = np.repeat(np.arange(len(self.docs)), self.lengths), len(self.docs)
        sums = np.bincount(doc, base[own], n)
        ids, held, _ = (list(x) for x in zip(*self.docs))
        return as_batch(_SCORES, ids, held, self.lengths.astype(np.int64), np.bincount(doc, self.c1[own] > 0, n).astype(np.int64), np.full(n, self.n), sums, sums + np.bincount(doc, added, n))


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _lefts(sums: np.ndarray, n: int) -> np.ndarray:
    """Of each context: log of the share left to other words, nan where its
    distribution doesn't diverge enough."""
    gain, counts, shorter, words, total = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        rest, others = 1 - (counts - DISCOUNT * words) / total, 1 - shorter
        left = np.where((words > 0) & (rest > 0) & (others > 0), np.log(rest / others), np.nan)
        gain = gain - counts * np.log(total) + (total - counts) * left
    return np.where(gain >= 0.5 * words * math.log(max(n, 1)), left, np.nan)


def _answer(n: int):
    """Sums over the blocks that ask, for one kind and part. Counts come with a
    bit: whether this block, the first, is to add the n-gram to its context."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
        keys, some, values = zip(*map(pickle.loads, rows.column("data").to_pylist()))
        keys, some = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in keys], [_unpacked(x, np.int32) for x in some]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        values = np.concatenate([_unpacked(x, np.int32) if kind < 4 else _unpacked(x, np.float64).reshape(5, -1) for x in values], axis=-1)
        found, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        types = 0
        if kind < 4:
            c = np.bincount(at, values, len(found)).astype(np.int64)
            types = int((c > 0).sum()) if kind == 1 else 0
            got = np.where(c >= (1 if kind == 1 else LEAST), c, 0)[at] << 1
            got[first] |= 1
        else:
            adding = at[np.concatenate([x + start for x, start in zip(some, [0, *ends])])]
            totals = np.zeros(len(found))
            totals[adding] = values[4]
            got = _lefts(np.stack([*(np.bincount(adding, x, len(found)) for x in values[:4]), totals]), n)[at]
        data = [_packed(x) for x in np.split(got, ends)]
        return pa.Table.from_batches([as_batch(_ROW, rows.column("block").combine_chunks(), [part] * len(data), [kind] * len(data), data, [types] + [0] * (len(data) - 1))])

    return run


class Scorer:
    """A corpus, what its blocks have learned from its training texts, and the scores."""

    def __init__(self, docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), (F.col(id_col).isNotNull() & ~F.coalesce(held_out, F.lit(False))).alias("trains"), F.col(text_col).alias("text"))
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // DOCS))
        self.known = [written(rows.coalesce(tasks).mapInArrow(_blocks, _ROWS), "blocks")]
        blocks, self.n = self.known[0].agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.parts, self.v = max(spark.sparkContext.defaultParallelism, blocks // 2), 0
        for step in range(1, 5):
            answers = written(self._blocks(step, _ROWS).groupBy("kind", "part").applyInArrow(_answer(self.n), _ROWS), "answers")
            if step == 1:
                self.v = answers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            self.known.append(answers)

    def _blocks(self, step: int, schema: str) -> DataFrame:
        """What the blocks ask or, last, find, with the answers known by now."""
        parts, n, v = self.parts, self.n, self.v

        def rows(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _View(pa.Table.from_batches([batch.slice(i, 1)]), parts, n, v).questions(step)

        def group(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(_View(table, parts, n, v).questions(step)), _SCORES if step == 5 else _ROW)

        if step == 1:
            return self.known[0].mapInArrow(rows, schema)
        known = self.known[0]
        for answers in self.known[1:]:
            known = known.unionByName(answers)
        return known.groupBy("block").applyInArrow(group, schema)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        return self._blocks(5, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return Scorer(docs, crc_bucket(F.col("doc_id"), 7) == 2).scores()
