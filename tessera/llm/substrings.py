"""Removal of byte strings that an earlier document has, by sorted suffixes.

Which suffixes to sort. Every 50 bytes have a key: the smallest hash among their
32-byte strings. Equal 50 bytes have equal keys. Neighbouring starts with one key
are a segment: about one in ten bytes, and one alone for a stretch that repeats a
short period. Only segments whose key several documents have can hold a repeated
string. Documents equal as a whole are settled before, by their digests.

How they are sorted. A task sends each distinct segment once, with the smallest
and the largest id of its documents. Where all segments of a key are equal,
nothing is left to sort. Of the others, dealt out by key, a task lays the texts
side by side and sorts all suffixes that start a 50-byte string, deep and
shallow: multikey quicksort, eight bytes a character, splits all groups at once
by a pivot into smaller, equal and larger; a group equal for 24 bytes goes to a
blind trie (a Patricia tree whose search looks at branching bits only and then
compares one leaf), unless it is so large that quicksort goes on. Suffixes equal
for 50 bytes come to stand together, and the smallest document id among them
decides for all.

What moves. The texts are read three times and never shuffled. The first pass
sends four bytes a segment to find shared keys, the second the segments of these,
and the third looks settled segments up. Keys and segments found lie in files of
the shared folder, cut by key into ranges that grow in number with the input and
are mapped by the workers. Segments of one key with different surroundings are
sorted by one task; equal ones are one row a task however many documents have
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.mapped import SortedSets, binary_rows, by_range, map_level, repeated_numbers, split_ranges, write_level
from tessera.llm.text import give_back, pieces
from tessera.llm.words import mixed, power, utf8
from tessera.sources.shared import cut, fresh_path, release
from tessera.sources.tables import table

WIDTH, GRAM = 50, 32
#: Quicksort goes as deep as this; groups above the size are sorted deeper before they go to a trie. The largest group
#: that goes there sets the rounds of all tries, and hot keys' groups grow with the input: the size must stay small.
SHALLOW, TRIE = 24, 32
#: Bytes of text for each range of keys; bytes of segments that a task holds; bytes whose suffixes are sorted at once.
RANGE, HELD, SORTED = 16 << 20, 8 << 20, 1 << 20
#: Bytes of segments that a task sends in a batch; bytes of text whose keys are looked up at once.
SENT, LOOKED = 1 << 20, 8 << 20
#: Documents with equal texts meet in so many parts.
SALTS = 16
#: Starts whose keys are found at once.
BLOCK = 1 << 17
_BYTE = np.random.default_rng(22).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def window_keys(b: np.ndarray) -> np.ndarray:
    """For each start of WIDTH bytes the smallest hash of their GRAM-byte strings."""
    h, width = _BYTE[b], 1
    for m in _M:  # twice the width with each step
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= _M[0]
    h ^= h >> np.uint64(29)
    span, width = WIDTH - GRAM + 1, 1
    while width < span:
        step = min(width, span - width)
        h = np.minimum(h[step:], h[: len(h) - step])
        width += step
    return h


def segments(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, document, first and last start (in ``flat``) of the segments of documents laid end to end."""
    n = len(flat) - WIDTH + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    least = np.concatenate([window_keys(flat[a : min(a + BLOCK, n) + WIDTH - 1]) for a in range(0, n, BLOCK)])
    ends = np.cumsum(sizes)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[(ends - sizes)[ends - sizes < n]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.append(first[1:], n) - 1, ends[doc] - WIDTH)
    keep = last >= first
    first, last, doc = first[keep], last[keep], doc[keep]
    return mixed(least[first]), doc, first, last  # least hashes are small numbers: mixed, they fill all ranges alike


def prints(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of segments."""
    up, down = power(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=sums[1:])
    return mixed((sums[last + WIDTH] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches of ``flat``, end to end."""
    return flat[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def _highest(x: np.ndarray) -> np.ndarray:
    """The place of the first set bit of 64, from the top; x is not 0."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


class Suffixes:
    """Suffixes of a text at given places, sorted by their first WIDTH bytes within groups.

    ``group`` has for each place where its group begins; groups are in order.
    """

    def __init__(self, flat: bytes, places: np.ndarray, group: np.ndarray | None = None):
        b = np.frombuffer(flat + bytes(WIDTH + 16), np.uint8)
        self.words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view(">u8").ravel().astype(np.uint64)
        self.places = places
        self.order = np.arange(len(places))  # suffixes in sorted order, at the end
        self.group = np.zeros(len(places), np.int64) if group is None else group.copy()  # where the group of the suffix at each rank begins

    def word(self, suffix: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """Eight bytes of each suffix; those beyond WIDTH are blank."""
        w = self.words[self.places[suffix] + depth]
        over = np.asarray(depth) + 8 - WIDTH
        return np.where(over > 0, (w >> np.uint64(8) * np.maximum(over, 0).astype(np.uint64)) << np.uint64(8) * np.maximum(over, 0).astype(np.uint64), w)

    def sort(self) -> np.ndarray:
        """Sorts, and returns for each rank whether its suffix differs from the one before."""
        n = len(self.places)
        depth = np.zeros(n, np.int64)  # bytes that the group at each rank is known to share
        rank = np.arange(n)
        while True:
            sizes = np.bincount(self.group, minlength=n)[self.group]
            rank = np.flatnonzero((sizes > 1) & ((depth < SHALLOW) | ((sizes > TRIE) & (depth < WIDTH))))
            if not len(rank):
                break
            self._split(rank, depth, sizes)
        sizes = np.bincount(self.group, minlength=n)[self.group]
        rank = np.flatnonzero((sizes > 1) & (depth < WIDTH))
        new = self.group == np.arange(n)
        if len(rank):
            self._blind(rank, new)
        return new

    def _split(self, rank: np.ndarray, depth: np.ndarray, sizes: np.ndarray) -> None:
        """One ternary step for the groups at ``rank`` (whole groups, in order)."""
        begin = self.group[rank]
        key = self.word(self.order[rank], depth[rank])
        offset = np.flatnonzero(rank == begin)  # where groups begin within `rank`
        size = sizes[rank[offset]]
        trio = np.sort(np.stack([key[offset], key[offset + size // 2], key[offset + size - 1]]), 0)
        pivot = np.repeat(trio[1], size)
        side = (key > pivot).astype(np.int8) - (key < pivot)
        to = np.empty(len(rank), np.int64)
        newgroup = np.empty(len(rank), np.int64)
        base = np.repeat(rank[offset], size)
        for s in (-1, 0, 1):
            own = side == s
            count = np.cumsum(own)
            before = np.repeat(count[offset] - own[offset], size)
            in_group = np.repeat(np.add.reduceat(own, offset), size)
            to[own] = (base + count - 1 - before)[own]
            newgroup[own] = base[own]
            base = base + in_group
        suffix = self.order[rank].copy()
        known = depth[rank] + np.where(side == 0, 8, 0)
        self.order[to], self.group[to], depth[to] = suffix, newgroup, known

    def _bit(self, suffix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (self.word(suffix, (bit >> 6) * 8) >> (63 - (bit & 63)).astype(np.uint64)) & np.uint64(1)

    def _blind(self, rank: np.ndarray, new: np.ndarray) -> None:
        """Orders groups by blind tries, one for each, into which all groups' r-th suffixes go at once."""
        begin = np.flatnonzero(rank == self.group[rank])
        size = np.diff(np.append(begin, len(rank)))
        member = self.order[rank]
        bit, child, leaves = np.zeros(len(rank), np.int64), np.full((len(rank), 2), 0), np.zeros(len(rank), np.int64)
        root = -begin - 1  # -k - 1: the leaf of member k
        leaf = np.arange(len(rank))  # the leaf that holds each member
        used = 0
        by_size = np.argsort(-size, kind="stable")
        for r in range(1, int(size.max())):
            live = by_size[: np.searchsorted(-size[by_size], -r, side="left")]
            x = begin[live] + r
            node = root[live].copy()
            while (inner := np.flatnonzero(node >= 0)).size:  # blind: only branching bits are looked at
                at = node[inner]
                node[inner] = child[at, self._bit(member[x[inner]], bit[at]).astype(np.int64)]
            met = -node - 1
            differ = np.full(len(live), -1)
            for depth in range(SHALLOW, WIDTH, 8):
                rest = np.flatnonzero(differ < 0)
                if not len(rest):
                    break
                diff = self.word(member[x[rest]], depth) ^ self.word(member[met[rest]], depth)
                some = np.flatnonzero(diff)
                differ[rest[some]] = depth * 8 + _highest(diff[some])
            same = differ < 0
            leaf[x[same]] = met[same]
            live, x, differ = live[~same], x[~same], differ[~same]
            if not len(live):
                continue
            above, side, node = np.full(len(live), -1), np.zeros(len(live), np.int64), root[live].copy()
            going = np.flatnonzero(node >= 0)
            going = going[bit[node[going]] < differ[going]]
            while len(going):
                at = node[going]
                leaves[at] += 1
                above[going], side[going] = at, self._bit(member[x[going]], bit[at]).astype(np.int64)
                node[going] = child[at, side[going]]
                going = going[node[going] >= 0]
                going = going[bit[node[going]] < differ[going]]
            fresh = used + np.arange(len(live))
            used += len(live)
            own = self._bit(member[x], differ).astype(np.int64)
            bit[fresh] = differ
            child[fresh, own], child[fresh, 1 - own] = -x - 1, node
            leaves[fresh] = 1 + np.where(node >= 0, leaves[np.maximum(node, 0)], 1)
            top = above < 0
            root[live[top]] = fresh[top]
            child[above[~top], side[~top]] = fresh[~top]
        # ranks of leaves, from the roots down
        place = np.zeros(len(rank), np.int64)
        node, base = root, np.zeros(len(root), np.int64)
        while len(node):
            ends = node < 0
            place[-node[ends] - 1] = base[ends]
            node, base = node[~ends], base[~ends]
            left = child[node, 0]
            weight = np.where(left >= 0, leaves[np.maximum(left, 0)], 1)
            node, base = np.concatenate([left, child[node, 1]]), np.concatenate([base, base + weight])
        place = place[leaf]
        group = np.repeat(np.arange(len(size)), size)
        by = np.lexsort([place, group])
        self.order[rank] = member[by]
        new[rank] = np.concatenate([[True], (np.diff(place[by]) != 0) | (np.diff(group[by]) != 0)])


def smallest_holders(flat: bytes, sizes: np.ndarray, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each 50-byte string of segments laid end to end the smallest owner of a segment with an equal string.

    Segments come by key; strings are only equal under one key.
    """
    count = sizes - WIDTH + 1
    before = np.cumsum(count) - count
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(before[first], np.add.reduceat(count, first))
    begin = np.cumsum(sizes) - sizes
    places = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    suffixes = Suffixes(flat, places, group)
    new = np.flatnonzero(suffixes.sort())
    own = np.repeat(owner, count)[suffixes.order]
    least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
    out = np.empty(len(own), np.int64)
    out[suffixes.order] = least
    return out


def _open(batch: pa.RecordBatch, copies: SortedSets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and sizes of the (doc_id, row, text) of a batch that are no copies."""
    row = batch.column(1).to_numpy().view(np.uint64)
    batch = batch.filter(pa.array(~copies.contains(row)))
    return batch.column(0).to_numpy(), *utf8(batch.column(2))


def _without_copies(docs: DataFrame, folder: str) -> tuple[SortedSets, int]:
    """The rows of (doc_id, row, text) that a smaller id equals as a whole, and the bytes of all texts."""
    text = F.col("text").cast("binary")
    slim = cut(docs.select("doc_id", "row", F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).alias("n")), "substring-digests")
    long = slim.filter(F.col("n") >= WIDTH)
    heads = long.groupBy("digest").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).filter("head < tail").select("digest", "head")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = long.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(heads, ["digest", "salt"]).filter("doc_id > head")
    copies = SortedSets.write(met.select(F.col("row").alias("key")), folder)
    total = slim.agg(F.sum("n")).first()[0] or 0
    release(docs.sparkSession, slim)
    return copies, total


def _shared_keys(docs: DataFrame, copies, n: int, folder: str) -> SortedSets:
    """The keys that segments of two rows or more have."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, mb=1):
            key, doc, _, _ = segments(*_open(batch, copies.value)[1:])
            yield key[np.unique(mixed(key + doc.astype(np.uint64) * _M[3]), return_index=True)[1]]  # once for a document

    return repeated_numbers(docs, keys, n, folder)


def _with_segments(parts: Iterator[tuple], shared: SortedSets) -> Iterator[list[tuple]]:
    """The (item, bytes, sizes) of pieces with their segments of shared keys, in lists: all ranges are visited once for a list."""

    def found() -> list[tuple]:
        ends = np.cumsum([0, *(len(x[0]) for _, x in waiting)])
        own = shared.contains(np.concatenate([x[0] for _, x in waiting]))
        return [(*part, *(y[own[a:b]] for y in x)) for (part, x), a, b in zip(waiting, ends[:-1], ends[1:], strict=True)]

    waiting, room = [], 0
    for part in parts:
        waiting.append((part, segments(*part[1:])))
        room += len(part[1])
        if room > LOOKED:
            yield found()
            waiting, room = [], 0
    if waiting:
        yield found()


def _held(docs: DataFrame, copies, shared, n: int) -> DataFrame:
    """(s, and arrays): each task's distinct segments with a shared key, by range: lower half of the key, print, smallest and largest id, size and bytes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            key, mark, doc, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
            start = np.cumsum(size) - size
            order = np.lexsort([mark, key])
            key, mark = key[order], mark[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]))
            low, high = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
            key, mark, start, size = key[new], mark[new], start[order[new]], size[order[new]]
            cuts = split_ranges(key, n)
            some = np.flatnonzero(np.diff(cuts))
            ends = np.cumsum(size)
            for part in np.split(some, np.flatnonzero(np.diff(ends[cuts[some + 1] - 1] // SENT)) + 1):  # a batch for so many bytes, not for each range
                own = slice(cuts[part[0]], cuts[part[-1] + 1])
                at = np.append(cuts[part], own.stop) - own.start
                arrays = [key[own].astype(np.uint32), mark[own], low[own], high[own], size[own]]
                bytes_ = gathered(text, start[own], size[own]), np.concatenate([[0], np.cumsum(size[own])])[at]
                yield pa.RecordBatch.from_arrays([pa.array(part), *[binary_rows(x, at) for x in arrays], binary_rows(*bytes_)], ["s", *"abcdef"])

        parts = (_open(batch, copies.value) for batch in pieces(batches, mb=1))
        for ids, flat, _, key, doc, first, last in chain.from_iterable(_with_segments(parts, shared.value)):
            if not len(key):
                continue
            size = last - first + WIDTH
            held.append((key, prints(flat, first, last), ids[doc], size, gathered(flat, first, size)))
            room += len(held[-1][-1])
            if room > HELD:
                yield from sent()
                held, room = [], 0
                give_back()
        if held:
            yield from sent()

    return docs.mapInArrow(collect, "s long, " + ", ".join(f"{c} binary" for c in "abcdef"))


def settle(key: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, text: np.ndarray) -> dict[str, np.ndarray]:
    """What is repeated in segments: prints in order, for each a range of runs of starts, for each run the smallest id that has them."""
    start = np.cumsum(size) - size
    order = np.lexsort([mark, key])
    key, mark = key[order], mark[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])) if len(key) else np.empty(0, np.int64)
    low, high = (np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)) if len(new) else (low, high)
    key, mark, start, size = key[new], mark[new], start[order[new]], size[order[new]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else new
    many = np.diff(np.append(first, len(key)))
    apart = (np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)) if len(first) else many > 0
    plain = np.flatnonzero(np.repeat((many == 1) & apart, many))
    owner, begin, end, least = [plain], [np.zeros(len(plain), np.int64)], [size[plain] - WIDTH], [low[plain]]
    sorted_ = np.flatnonzero(np.repeat((many > 1) & apart, many))
    cuts = np.flatnonzero(np.concatenate([[True], key[sorted_][1:] != key[sorted_][:-1]])) if len(sorted_) else sorted_
    weight = np.cumsum(size[sorted_]) // SORTED
    cuts = cuts[np.concatenate([[True], weight[cuts][1:] != weight[cuts][:-1]])] if len(cuts) else cuts
    for own in np.split(sorted_, cuts[1:]) if len(cuts) else ():
        m = smallest_holders(gathered(text, start[own], size[own]).tobytes(), size[own], low[own], key[own])
        count = size[own] - WIDTH + 1
        segment = np.repeat(np.arange(len(own)), count)
        run = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (segment[1:] != segment[:-1])]))
        until = np.append(run[1:], len(m)) - 1
        useful = m[run] < high[own][segment[run]]
        run, until = run[useful], until[useful]
        at = (np.cumsum(count) - count)[segment[run]]
        owner, begin, end, least = owner + [own[segment[run]]], begin + [run - at], end + [until - at], least + [m[run]]
    owner, begin, end, least = (np.concatenate(x).astype(np.int64) for x in (owner, begin, end, least))
    by = np.argsort(mark[owner], kind="stable")
    known, count = np.unique(mark[owner], return_counts=True)
    width = np.min_scalar_type(int(end.max()) if len(end) else 0)
    return {"print": known, "at": np.concatenate([[0], np.cumsum(count)]).astype(np.uint32), "first": begin[by].astype(width), "last": end[by].astype(width), "least": least[by]}


def _settled(held: DataFrame, folder: str) -> dict[int, str]:
    """Files of what is repeated, by range."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        kinds = (np.uint32, np.uint64, np.int64, np.int64, np.int64, np.uint8)
        give_back()
        arrays = [np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in zip("abcdef", kinds, strict=True)]
        path = write_level(folder, settle(*arrays))
        give_back()
        return pa.Table.from_pydict({"s": [key[0].as_py()], "path": [path]})

    return {r.s: r.path for r in held.groupBy("s").applyInArrow(merge, "s long, path string").collect()}


class Settled:
    """Looks up what is repeated in a segment."""

    def __init__(self, paths: dict[int, str], n: int):
        self.paths, self.n, self.opened = paths, n, {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def runs(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each run of a segment, segments in order: the segment, first and last start in it, and the smallest id that has them."""
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        for s, own in by_range(key, self.n):
            if s not in self.paths:
                continue
            a = self.opened[s] if s in self.opened else self.opened.setdefault(s, map_level(self.paths[s]))
            known = a["print"]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, mark[own]), len(known) - 1)
            found = known[at] == mark[own]
            own, at = own[found], at[found]
            count = a["at"][at + 1].astype(np.int64) - a["at"][at]
            run = np.arange(count.sum()) + np.repeat(a["at"][at] - (np.cumsum(count) - count), count)
            for x, y in zip(out, (np.repeat(own, count), a["first"][run], a["last"][run], a["least"][run]), strict=True):
                x.append(y.astype(np.int64))
        out = [np.concatenate(x) for x in out]
        by = np.argsort(out[0], kind="stable")
        return tuple(x[by] for x in out)


def remove_repeats(docs: DataFrame, as_text: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """``docs`` with kept (binary: what is left of the text), n_bytes, n_removed and n_spans.

    With ``as_text`` kept is a string, without the bytes of characters cut in two.

    Bytes are those of the UTF-8 text, null as empty. A byte goes if 50 bytes
    around it also start in a document with a smaller id; strings are judged on
    the input, overlaps count, and no string crosses documents. A row without id
    keeps its text and takes nothing from others; rows that repeat an id are no
    smaller than each other. An empty table gives no row. All columns are kept;
    those named like a result are replaced. ``range_bytes`` of text go to each
    range of keys.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "substring-files")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text")).filter("doc_id is not null")
    copies, total = _without_copies(slim, folder)
    n = 1 + total // range_bytes
    copies_sent = spark.sparkContext.broadcast(copies)
    shared = _shared_keys(slim, copies_sent, n, folder)
    release(spark)
    shared_sent = spark.sparkContext.broadcast(shared)
    settled = spark.sparkContext.broadcast(Settled(_settled(_held(slim, copies_sent, shared_sent, n), folder), n))
    release(spark)
    rest = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    at = rest.index("text")
    ids = [F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((batch, *utf8(batch.column(at))) for batch in pieces(batches, mb=1))
        for group in _with_segments(parts, shared_sent.value):
            keys, marks = [x[3] for x in group], [prints(flat, first, last) for _, flat, _, _, _, first, last in group]
            runs = settled.value.runs(np.concatenate(keys), np.concatenate(marks))
            base = np.cumsum([0, *map(len, keys)])
            cuts = np.searchsorted(runs[0], base)
            for i, (batch, flat, sizes, _, doc, first, last) in enumerate(group):
                segment, begin, end, least = (x[cuts[i] : cuts[i + 1]] for x in runs)
                yield left_of(batch, flat, sizes, doc, first, last, segment - base[i], begin, end, least)

    def left_of(batch, flat, sizes, doc, first, last, segment, begin, end, least) -> pa.RecordBatch:
        owner, row = batch.column(len(rest)), batch.column(len(rest) + 1).to_numpy().view(np.uint64)
        valid = owner.is_valid().to_numpy(zero_copy_only=False)
        owner = owner.fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        use = valid[doc[segment]] & (least < owner[doc[segment]])
        begin, end = (first[segment] + begin)[use], (first[segment] + end)[use] + WIDTH
        copy = np.flatnonzero(copies_sent.value.contains(row) & valid & (sizes >= WIDTH))
        begin, end = np.concatenate([begin, (ends - sizes)[copy]]), np.concatenate([end, ends[copy]])
        gone = np.cumsum(np.bincount(begin, minlength=len(flat) + 1) - np.bincount(end, minlength=len(flat) + 1))[:-1] > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        border = (ends - sizes)[sizes > 0]
        starts[border] = gone[border]
        per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        removed, spans = per_doc(gone), per_doc(starts)
        offsets = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
        left = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[~gone].tobytes())])
        if as_text:
            left = pa.array([x.decode("utf-8", "ignore") for x in left.to_pylist()], pa.string())
        more = [left, *[pa.array(x.astype(np.int64)) for x in (sizes, removed, spans)]]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *more], [*rest, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = docs.select(*rest).schema.add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return docs.select(*rest, ids[0].alias("_owner"), ids[1].alias("_row")).mapInArrow(run, schema)


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: 50-byte strings."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
