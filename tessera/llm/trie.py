"""A word trigram model as an Elias-Fano trie in memory-mapped files, built by Spark.

Levels. The first has all words of the training documents by hash, with exact
counts; a word's id is its place among all. The second has all bigrams: the
sequence ``local(w1) * V + w2`` of a shard, and for each w1 a monotone pointer to
its successors. The third has all trigrams; the last word is stored relative to
its context, as its place among the successors of the middle word, which is a
far smaller number than its id. Sequences and pointers are Elias-Fano coded with
low parts of as many bits as they need; logarithms of interpolated probabilities
and of back-off weights take a byte. No n-gram is left out.

Building. One pass counts words. A second turns each task's texts into sorted
counts of trigrams below their bigrams, cut by shard: one compact row for each
task and shard. A shard's rows are merged by one task, which writes the second
level; then, as successors' places are known, each shard's third level is
written. Shards hold the bigrams of the first words with one remainder; a hot
first word's bigrams are dealt over all shards by both words. A single bigram's
trigrams stay in one shard: their number is that of the distinct words behind
it. Files lie in the folder that all executors share; workers map them and read
only the pages they need.

Probabilities. P1 = (c + 0.1) / (N + 0.1 (V + 1)). An n-gram of count c in a
context of count t has (c - D) / t plus the context's weight times the lower
order's probability; the weight is D times the context's successors over t. A
text's first word stands behind an end; a word that training never saw ends a
context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.mapped import least, map_level, write_level
from tessera.llm.text import crc_mod, give_back, pieces
from tessera.llm.words import mixed, utf8, word_hashes
from tessera.sources.shared import fresh_path, release, remove
from tessera.sources.tables import table

#: Discounts of bigrams and trigrams.
D2, D3 = 0.9, 0.9
#: Bytes of text for a shard of the first level; tokens of one of the others. A word with half as many tokens is hot.
TEXT, TOKENS = 64 << 20, 2_000_000
#: Tokens that a task holds before it sorts and sends them.
ROOM = 3_000_000
END = np.uint64(0x27D4EB2F165667C5)  # the hash of a text's end
#: A byte q stands for 10 ** (-q / STEPS); 255 for none.
STEPS = 24


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 254).astype(np.uint8)


#: The numbers that bytes stand for.
_POWER = 10.0 ** (np.arange(256) / -STEPS)


def log10_of(q: np.ndarray) -> np.ndarray:
    return q.astype(float) / -STEPS


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, behind that width."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(x: bytes) -> np.ndarray:
    """The numbers of :func:`narrow`."""
    rows = np.frombuffer(x, np.uint8, offset=1).reshape(-1, x[0])
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : x[0]] = rows
    return out.view("<i8").ravel()


def squeezed(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers that are read once, compressed."""
    raw = narrow(x)
    return {name: np.frombuffer(pa.compress(raw, "zstd", asbytes=True), np.uint8), f"{name}_size": np.array([len(raw)])}


def unsqueezed(a: dict[str, np.ndarray], name: str) -> np.ndarray:
    return widened(pa.decompress(a[name].tobytes(), int(a[f"{name}_size"][0]), "zstd", asbytes=True))


def small(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 and more stand aside with their places."""
    big = np.flatnonzero(x >= 255)
    return {name: np.minimum(x, 255).astype(np.uint8), f"{name}_at": big, f"{name}_big": x[big].astype(np.int64)}


def whole(a: dict[str, np.ndarray], name: str) -> np.ndarray:
    """The counts that :func:`small` wrote."""
    x = a[name].astype(np.int64)
    x[a[f"{name}_at"]] = a[f"{name}_big"]
    return x


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, end to end in 64-bit words; one word more than needed."""
    out = []
    for a in range(0, len(values) if width else 0, 65_536):  # a multiple of 64 values fills whole words
        bits = (values[a : a + 65_536, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
        row = np.packbits(bits.ravel(), bitorder="little").tobytes()
        out.append(row + bytes(-len(row) % 8))
    return np.frombuffer(b"".join([*out, bytes(8)]), np.uint64)


_U = np.arange(256, dtype=np.uint64)
_X = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080)]
#: The place of the k-th set bit of a byte.
_NTH = np.zeros((256, 9), np.uint64)
for _k in range(8):
    _set = (np.arange(256) >> _k) & 1 == 1
    _NTH[_set, np.bitwise_count(np.arange(256) & ((2 << _k) - 1))[_set]] = _k


class EliasFano:
    """A non-decreasing sequence below 2**62: low bits packed, high bits in unary."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.zeros = parts["low"], parts["high"], parts["zeros"]
        self.n, self.shift = (int(x) for x in parts["head"])

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        v = np.asarray(values, np.uint64)
        n = len(v)
        shift = max(0, int(np.log2(max(1, (int(v[-1]) + 1) / n)))) if n else 0
        high = (v >> np.uint64(shift)).astype(np.int64)
        at = high + np.arange(n)
        bits = np.zeros(((int(at[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        bits[at] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        return {"low": packed(v, shift), "high": words, "zeros": zeros.astype(np.uint32), "head": np.array([n, shift], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low parts at places."""
        if not self.shift:
            return np.zeros(len(i), np.int64)
        bit = i * self.shift
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        over = self.low[word + 1] << (np.uint64(63) - off) << np.uint64(1)
        return ((self.low[word] >> off | over) & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def _select(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit (from 1) of each word; k is at most the word's number of them."""
        s = words - ((words >> _U[1]) & _X[0])
        s = (s & _X[1]) + ((s >> _U[2]) & _X[1])
        before = ((s + (s >> _U[4])) & _X[2]) * _X[3]  # byte i: set bits of bytes 0 to i
        byte = np.bitwise_count((before + (_U[128] - k) * _X[3]) & _X[4] ^ _X[4]).astype(np.uint64) << _U[3]
        rest = k - ((before << _U[8]) >> byte & _U[255])
        return (byte + _NTH[(words >> byte & _U[255]).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)

    def _start(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements whose high part is below ``h``, that is ones before the h-th zero; and the bit behind that zero."""
        word = np.maximum(np.searchsorted(self.zeros, h.astype(self.zeros.dtype), side="left") - 1, 0)
        left = np.maximum(h - self.zeros[word].astype(np.int64), 1).astype(np.uint64)  # zeros to pass in this word
        behind = np.where(h > 0, word * 64 + self._select(~self.high[word], left) + 1, 0)
        return behind - h, behind

    def find(self, v: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if it is not there."""
        v = np.asarray(v, np.int64)
        out = np.full(len(v), -1)
        if not self.n:
            return out
        top = int(self.zeros[-1])
        h, want = v >> self.shift, v & ((1 << self.shift) - 1)
        a, behind = self._start(np.minimum(h, top))
        word = behind >> 6
        rest = ~self.high[np.minimum(word, len(self.high) - 1)] >> (behind & 63).astype(np.uint64)
        run = np.bitwise_count((rest & (~rest + _U[1])) - _U[1]).astype(np.int64)  # ones from there on; 64 if they reach the word's end
        end = a + run
        far = np.flatnonzero((rest == 0) & (h < top))
        end[far] = self._start(h[far] + 1)[0]
        live = np.flatnonzero((h < top) & (a < end))
        a, end, want = a[live], end[live], want[live]
        while len(live):
            mid = (a + end) >> 1
            low = self._low(mid)
            hit = low == want
            out[live[hit]] = mid[hit]
            less = low < want
            a, end = np.where(less, mid + 1, a), np.where(less, end, mid)
            keep = np.flatnonzero(~hit & (a < end))
            live, a, end, want = live[keep], a[keep], end[keep], want[keep]
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Elements at places."""
        i = np.asarray(i, np.int64)
        ones = np.arange(1, len(self.high) + 1) * 64 - self.zeros[1:].astype(np.int64)
        word = np.searchsorted(ones, i, side="right")
        left = i - np.where(word > 0, ones[word - 1], 0) + 1
        at = self._select(self.high[word], left.astype(np.uint64))
        return (word * 64 + at - i << self.shift) + self._low(i)


def _part(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}_{k}"] for k in ("low", "high", "zeros", "head")})


def _named(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": x for k, x in EliasFano.parts(values).items()}


class Levels:
    """The files of a model, opened when first needed.

    ``base`` has the first id of each shard of words. ``hot`` are the ids, in
    order, of words whose bigrams are dealt over all shards of the other levels.
    """

    def __init__(self, words: list[str | None], base: list[int], tokens: int, hot: np.ndarray | None = None, shards: int = 1):
        self.paths: dict[str, list[str | None]] = {"words": words, "bigrams": [], "counts": [], "probabilities": [], "trigrams": []}
        self.base, self.tokens, self.distinct = np.array(base, np.int64), tokens, base[-1]
        self.hot = np.empty(0, np.int64) if hot is None else hot
        self.hot_weight = np.full(len(self.hot), 255, np.uint8)
        self.shards, self.fanout = shards, 1
        self.opened: dict[tuple[str, int], dict | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def level(self, kind: str, shard: int) -> dict | None:
        key = (kind, shard)
        if key not in self.opened:
            path = self.paths[kind][shard]
            a = map_level(path) if path else None
            if a is not None and "keys_low" in a:
                a = a | {"keys": _part(a, "keys")} | ({"pointers": _part(a, "pointers")} if "pointers_low" in a else {})
            self.opened[key] = a
        return self.opened[key]

    def _by_shard(self, kind: str, shard: np.ndarray) -> Iterator[tuple[dict, int, np.ndarray]]:
        """Each shard's level, its number, and the queries that go there (-1: nowhere)."""
        order = np.argsort(shard.astype(np.int32), kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-2))
        for own in np.split(order, cuts[1:]) if len(order) else ():
            s = int(shard[own[0]])
            a = self.level(kind, s) if s >= 0 else None
            if a is not None:
                yield a, s, own

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and count of each word."""
        ids, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for a, s, own in self._by_shard("words", shard_of_word(hashes, len(self.paths["words"]))):
            h, known = hashes[own], a["hash"]
            bucket = np.minimum((h - known[0]) >> np.uint64(int(a["shift"][0])), np.uint64(len(a["index"]) - 2)).astype(np.int64)
            bucket = np.where(h < known[0], 0, bucket)
            at, end = a["index"][bucket].astype(np.int64), a["index"][bucket + 1].astype(np.int64)
            live = np.flatnonzero(at < end)
            while len(live := live[known[at[live]] < h[live]]):
                at[live] += 1
                live = live[at[live] < end[live]]
            hit = np.flatnonzero(at < end)
            hit = hit[known[at[hit]] == h[hit]]
            ids[own[hit]], count[own[hit]] = at[hit] + self.base[s], a["count"][at[hit]]
        return ids, count

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id."""
        out, shard = np.empty(len(ids), np.int64), np.searchsorted(self.base, ids, side="right") - 1
        for a, s, own in self._by_shard("words", shard):
            out[own] = a["count"][ids[own] - self.base[s]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))

    def dealt(self, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard of each bigram, the number of w1 there, and whether w1 is hot."""
        shard, local = w1 % self.shards, w1 // self.shards
        hot = np.zeros(len(w1), bool)
        if len(self.hot):
            rank = np.minimum(np.searchsorted(self.hot, w1), len(self.hot) - 1)
            hot = self.hot[rank] == w1
            both = mixed(w1[hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w2[hot].astype(np.uint64))
            shard[hot] = (both % np.uint64(self.shards)).astype(np.int64)
            local[hot] = self.distinct // self.shards + 1 + rank[hot]
        return shard, local, hot

    def weights(self, w1: np.ndarray) -> np.ndarray:
        """Weight byte of each word as a context (255: none)."""
        out = np.full(len(w1), 255, np.uint8)
        shard, local, hot = self.dealt(w1, w1)
        if hot.any():
            out[hot] = self.hot_weight[np.searchsorted(self.hot, w1[hot])]
        for a, _, own in self._by_shard("bigrams", np.where(hot, -1, shard)):
            out[own] = a["weight"][np.minimum(local[own], len(a["weight"]) - 1)]
            out[own[local[own] >= len(a["weight"])]] = 255
        return out

    def bigrams(self, w1: np.ndarray, w2: np.ndarray, with_probabilities: bool = True) -> tuple[np.ndarray, ...]:
        """Shard, place there and number among w1's successors (-1: none) of bigrams; their probability and weight bytes (255: none)."""
        place, among = np.full(len(w1), -1), np.full(len(w1), -1)
        p, weight = np.full(len(w1), 255, np.uint8), np.full(len(w1), 255, np.uint8)
        shard, local, hot = self.dealt(w1, w2)
        for a, s, own in self._by_shard("bigrams", shard):
            at = a["keys"].find(local[own] * self.distinct + w2[own])
            hit = np.flatnonzero(at >= 0)
            own, at = own[hit], at[hit]
            if len(own):
                place[own] = at
                among[own] = at - a["pointers"][local[own]]
                if with_probabilities:
                    b = self.level("probabilities", s)
                    p[own], weight[own] = b["p"][at], b["weight"][at]
        among = np.where(hot & (among >= 0), among * self.shards + shard, among)
        return shard, place, among, p, weight

    def pair_counts(self, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Counts of bigrams, while the model is built."""
        out = np.zeros(len(place), np.int64)
        for a, _, own in self._by_shard("counts", shard):
            x = a["count"][place[own]].astype(np.int64)
            big = np.flatnonzero(x == 255)
            x[big] = a["count_big"][np.searchsorted(a["count_at"], place[own[big]])]
            out[own] = x
        return out

    def trigrams(self, shard: np.ndarray, place: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Probability byte (255: none) of the word that stands at ``among`` the middle word's successors behind the bigram at ``place``."""
        p = np.full(len(place), 255, np.uint8)
        for a, _, own in self._by_shard("trigrams", shard):
            key = place[own] * self.fanout + among[own]
            order = np.argsort(key)
            at = a["keys"].find(key[order])
            hit = np.flatnonzero(at >= 0)
            p[own[order[hit]]] = a["p"][at[hit]]
        return p


def shard_of_word(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shards cut the range of hashes into ``n``."""
    return ((hashes >> np.uint64(33)) * np.uint64(max(n, 1)) >> np.uint64(31)).astype(np.int64)


def token_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    hashes, counts = word_hashes(*utf8(column))
    out = np.full(len(hashes) + len(counts), END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
    return out, counts + 1


def contexts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the token before each lies, and the one before that (a text's first: its end; -1: none)."""
    ends = np.cumsum(sizes)
    first = ends - sizes
    before = np.arange(ends[-1] if len(ends) else 0) - 1
    before[first] = ends - 1
    second = before - 1
    second[first] = -1
    inner = first[sizes > 1] + 1
    second[inner] = ends[sizes > 1] - 1
    return before, second


def _word_counts(docs: DataFrame, n: int) -> DataFrame:
    """(s, hashes, counts): each task's tokens and their counts, by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(shard_of_word(k, n), np.arange(n + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([k[own].tobytes()]), pa.array([narrow(c[own])])], ["s", "hashes", "counts"])

        for batch in pieces(batches, mb=4):
            held.append(token_hashes(batch.column(0))[0])
            size += len(held[-1])
            if size > ROOM:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "s long, hashes binary, counts binary")


def _shards(built: DataFrame, n: int) -> tuple[list[str | None], list]:
    rows = {r.shard: r for r in built.collect()}
    return [rows[s].path if s in rows else None for s in range(n)], [rows.get(s) for s in range(n)]


def _first_level(docs: DataFrame, folder: str, size: int, hot_from: int) -> tuple[Levels, dict[int, int]]:
    """The words of ``docs``, and the counts of ids with at least ``hot_from`` tokens."""
    n = 1 + (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // size

    def build(key: tuple, group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()])
        c = np.concatenate([widened(x) for x in group.column("counts").to_pylist()])
        by = np.argsort(h)
        h, c = h[by], c[by]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[new], np.add.reduceat(c, new)
        span = int(h[-1] - h[0])
        shift = max(0, span.bit_length() - max(1, len(h).bit_length() - 1))
        bucket = ((h - h[0]) >> np.uint64(shift)).astype(np.int64)
        index = np.searchsorted(bucket, np.arange(bucket[-1] + 2))
        path = write_level(folder, {"hash": h, "count": least(c), "index": least(index), "shift": np.array([shift])})
        often = np.flatnonzero(c >= hot_from)
        give_back()
        return pa.Table.from_pydict({"shard": [key[0].as_py()], "path": [path], "tokens": [int(c.sum())], "distinct": [len(h)], "hot": [often.tolist()], "n": [c[often].tolist()]},
                                    schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("hot", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    built = _word_counts(docs, n).groupBy("s").applyInArrow(build, "shard long, path string, tokens long, distinct long, hot array<long>, n array<long>")
    paths, stats = _shards(built, n)
    release(docs.sparkSession)
    base = np.cumsum([0, *(r.distinct if r else 0 for r in stats)]).tolist()
    hot = {base[s] + i: c for s, r in enumerate(stats) if r for i, c in zip(r.hot, r.n, strict=True)}
    return Levels(paths, base, sum(r.tokens for r in stats if r)), hot


def _trigram_counts(docs: DataFrame, sent) -> DataFrame:
    """(s, and six arrays): each task's trigrams of shard s, below their bigrams, below their first words.

    A bigram that ends a text has one trigram, whose last word is V.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Levels = sent.value
        v = np.int64(max(m.distinct, 1))
        pairs, lasts, size = [], [], 0

        def sorted_counts() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(pairs)
            pairs.clear()
            pair, back = np.unique(every, return_inverse=True)
            del every
            shard = m.dealt(pair // v, pair % v)[0]
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(pair), np.int64)
            rank[order] = np.arange(len(pair))
            pair, cuts = pair[order], np.searchsorted(shard[order], np.arange(m.shards + 1))
            back = rank[back] * (v + 1)
            back += np.concatenate(lasts)
            lasts.clear()
            triple, n = np.unique(back, return_counts=True)
            del back, rank
            above, last = triple // (v + 1), triple % (v + 1)
            bounds = np.searchsorted(above, cuts)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own, low, high = pair[cuts[s] : cuts[s + 1]], bounds[s], bounds[s + 1]
                w1, below = np.unique(own // v, return_counts=True)
                arrays = [w1, below, own % v, np.bincount(above[low:high] - cuts[s]), last[low:high], n[low:high]]
                yield pa.RecordBatch.from_arrays([pa.array([s]), *[pa.array([narrow(x)]) for x in arrays]], ["s", *"abcdef"])

        for batch in pieces(batches, mb=4):
            hashes, sizes = token_hashes(batch.column(0))
            w = m.words(hashes)[0]
            before, _ = contexts(sizes)
            last = np.append(w[1:], v)
            last[np.cumsum(sizes) - 1] = v
            pairs.append(w[before] * v + w)
            lasts.append(last)
            size += len(w)
            if size > ROOM:
                yield from sorted_counts()
                size = 0
        if size:
            yield from sorted_counts()
        give_back()

    names = ", ".join(f"{c} binary" for c in "abcdef")
    return docs.select(F.col("text").cast("string")).mapInArrow(run, f"s long, {names}")


def _second_level(rows: DataFrame, sent, folder: str) -> DataFrame:
    """Writes the bigrams of each shard, and aside their counts and trigrams for the third level."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        s, m = key[0].as_py(), sent.value
        v = np.int64(max(m.distinct, 1))
        w1, below, w2, deep, last, n = (np.concatenate([widened(x) for x in group.column(c).to_pylist()]) for c in "abcdef")
        _, local, _ = m.dealt(np.repeat(w1, below), w2)
        pair, back = np.unique(local * v + w2, return_inverse=True)
        triple = np.repeat(back, deep) * (v + 1) + last
        order = np.argsort(triple)
        triple, n = triple[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]]))
        triple, n = triple[new], np.add.reduceat(n, new)
        place, last = triple // (v + 1), triple % (v + 1)
        count = np.bincount(place, weights=n).astype(np.int64)
        local, cold = pair // v, m.distinct // m.shards + 1
        successors = np.bincount(local, minlength=cold)
        known = np.flatnonzero(successors[:cold])
        weight = np.full(cold, 255, np.uint8)
        weight[known] = quantise(D2 * successors[known] / m.count(known * m.shards + s))
        pointers = np.concatenate([[0], np.cumsum(successors)])
        path = write_level(folder, {"weight": weight} | _named("keys", pair) | _named("pointers", pointers))
        inner = last < v
        aside = write_level(folder, squeezed("last", last[inner]) | squeezed("n", n[inner]) | squeezed("deep", np.bincount(place[inner], minlength=len(pair))) | small("count", count))
        give_back()
        hot = np.flatnonzero(successors[cold:])
        return pa.Table.from_arrays([pa.array([x], t) for x, t in ((s, pa.int64()), (path, pa.string()), (aside, pa.string()), (int(successors.max()), pa.int64()), (hot.tolist(), pa.list_(pa.int64())), (successors[cold:][hot].tolist(), pa.list_(pa.int64())))],
                                    ["shard", "path", "aside", "most", "hot", "n"])

    return rows.groupBy("s").applyInArrow(merge, "shard long, path string, aside string, most long, hot array<long>, n array<long>")


def _third_level(spark, sent, folder: str, shards: int) -> DataFrame:
    """Writes the probabilities of each shard's bigrams, and its trigrams."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Levels = sent.value
        v, cold = np.int64(max(m.distinct, 1)), m.distinct // m.shards + 1
        for s in (s for batch in batches for s in batch.column(0).to_pylist()):
            if not m.paths["bigrams"][s]:
                continue
            a, b = m.level("counts", s), m.level("bigrams", s)
            count, n, successors, last = whole(a, "count"), *(unsqueezed(a, name) for name in ("n", "deep", "last"))
            place = np.repeat(np.arange(len(count)), successors)
            pair = b["keys"][np.arange(len(count))]
            local, w2 = pair // v, pair % v
            w1 = np.where(local < cold, local * m.shards + s, m.hot[np.maximum(local - cold, 0)] if len(m.hot) else 0)
            p = quantise((count - D2) / m.count(w1) + _POWER[m.weights(w1)] * m.unigram(m.count(w2)))
            weight = np.where(successors > 0, quantise(D3 * successors / count), 255).astype(np.uint8)
            probabilities = write_level(folder, {"p": p, "weight": weight})
            # neighbours in the order of their bigrams are neighbours in the files
            order = np.argsort(w2[place] * v + last)
            place, last, n = place[order], last[order], n[order]
            shard, at, among, _, _ = m.bigrams(w2[place], last, with_probabilities=False)
            below = _POWER[m.weights(w2)]
            lower = quantise((m.pair_counts(shard, at) - D2) / m.count(w2)[place] + below[place] * m.unigram(m.count(last)))
            p = quantise((n - D3) / count[place] + _POWER[weight][place] * _POWER[lower])
            key = place * m.fanout + among
            order = np.argsort(key)
            path = write_level(folder, {"p": p[order]} | _named("keys", key[order]))
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([probabilities]), pa.array([path])], ["shard", "probabilities", "path"])
            give_back()

    return spark.range(shards).repartition(shards, "id").mapInArrow(build, "shard long, probabilities string, path string")


def fit(docs: DataFrame, text: int = TEXT, tokens: int = TOKENS) -> Levels:
    """The model of the texts of ``docs`` (null texts are empty), in shards of the words of about ``text`` bytes and of ``tokens`` tokens."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "trie")
    model, often = _first_level(docs, folder, text, max(2, tokens // 2))
    model.shards = 1 + model.tokens // tokens
    if model.shards > 1:
        model.hot = np.array(sorted(often), np.int64)
    model.hot_weight = np.full(len(model.hot), 255, np.uint8)
    sent = spark.sparkContext.broadcast(model)
    paths, stats = _shards(_second_level(_trigram_counts(docs, sent), sent, folder), model.shards)
    release(spark)
    model.paths["bigrams"], model.paths["counts"] = paths, [r and r.aside for r in stats]
    successors = np.zeros(len(model.hot), np.int64)
    for r in filter(None, stats):
        np.add.at(successors, np.array(r.hot, np.int64), np.array(r.n, np.int64))
    if len(model.hot):
        model.hot_weight = quantise(D2 * successors / np.array([often[i] for i in model.hot.tolist()]))
    model.fanout = max([r.most for r in stats if r], default=1) * (model.shards if len(model.hot) else 1)
    sent.destroy()
    sent = spark.sparkContext.broadcast(model)
    last = {r.shard: r for r in _third_level(spark, sent, folder, model.shards).collect()}
    for s, aside in enumerate(model.paths["counts"]):
        if aside:
            remove(spark, aside)
    model.paths |= {"counts": [], "probabilities": [last[s].probabilities if s in last else None for s in range(model.shards)], "trigrams": [last[s].path if s in last else None for s in range(model.shards)]}
    model.opened = {}
    return model


def log10_tokens(m: Levels, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, log10 P1 and the model's log10 P of each token."""
    w, count = m.words(hashes)
    base = np.log10(m.unigram(count))
    before, second = contexts(sizes)
    # bigrams that stand in the texts, each looked up once
    v = np.int64(max(m.distinct, 1))
    known = np.flatnonzero((w >= 0) & (w[before] >= 0))
    pair, back = np.unique(w[before[known]] * v + w[known], return_inverse=True)
    found = m.bigrams(pair // v, pair % v)
    shard, place, among = np.zeros(len(w), np.int64), np.full(len(w), -1), np.full(len(w), -1)
    p, inner = np.full(len(w), 255, np.uint8), np.full(len(w), 255, np.uint8)
    for x, own in zip((shard, place, among, p, inner), found, strict=True):
        x[known] = own[back]
    full = np.where(p < 255, log10_of(p), base)
    off = np.flatnonzero((p == 255) & (w[before] >= 0))
    weight = m.weights(w[before[off]])
    full[off] += np.where(weight < 255, log10_of(weight), 0.0)
    deep = np.flatnonzero((second >= 0) & (place[before] >= 0))
    found = np.full(len(deep), 255, np.uint8)
    whole = np.flatnonzero(among[deep] >= 0)
    at = before[deep[whole]]
    found[whole] = m.trigrams(shard[at], place[at], among[deep[whole]])
    weight = inner[before[deep]]
    full[deep] = np.where(found < 255, log10_of(found), full[deep] + np.where(weight < 255, log10_of(weight), 0.0))
    return count, base, full


def score(docs: DataFrame, model: Levels) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text of ``docs``.

    ``score`` is the model's log10 probability of the words and the end. Null and
    empty texts are the end alone. Null ids and repeated rows give a row each;
    an empty table gives none, and columns besides doc_id and text play no part.
    With no training document the counts are 0 and both scores are 0 (V = 0, and
    every token is equally unknown).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, mb=4):
            hashes, sizes = token_hashes(batch.column(1))
            first = np.cumsum(sizes) - sizes
            count, base, full = log10_tokens(sent.value, hashes, sizes)
            known = np.add.reduceat((count > 0).astype(np.int64), first)
            columns = [sizes, known, np.full(len(sizes), sent.value.tokens), np.add.reduceat(base, first), np.add.reduceat(full, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scores(spark, sf_dir: str) -> DataFrame:
    """All ``documents``; learned from those whose crc32 modulo 10 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 10)
    out = score(docs, fit(docs.filter(held != 0)))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
