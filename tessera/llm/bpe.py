"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into pre-tokens; those that the worker has not met lie, many at a
time, as symbols in one flat array. Each round forms the keys of all adjacent
symbols, finds their ranks by binary search in the vocabulary's sorted pair
keys, takes the lowest rank of each word, and merges that pair everywhere in
the word. Words without a pair left leave the array. Their ids are kept in a
bounded cache of the worker. Decoding gathers the bytes of all ids of a batch
in one step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import held, pieces, texts
from tessera.sources.tables import table

#: Words of the worker's cache before it starts anew; longer words are not cached.
CACHE, CACHED_BYTES = 150_000, 64
#: Symbols merged in one flat array.
FLAT = 400_000
NONE = np.int32(2**31 - 1)

#: Fixed value: the pre-token pattern of byte-level vocabularies, white space spelled out as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"



def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizer file (model.vocab, model.merges, added_tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        code = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(code[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.size = np.int64(size)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are not empty."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.arange(len(words))
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1] = self.rank(sym[:-1].astype(np.int64), sym[1:].astype(np.int64))
            rank[starts + sizes - 1] = NONE  # a word's last symbol has no pair
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[ids[i]] = sym[starts[i] : starts[i] + sizes[i]]
                stay = np.repeat(~done, sizes)
                sym, rank, sizes, ids, least = sym[stay], rank[stay], sizes[~done], ids[~done], least[~done]
                if not len(ids):
                    break
                starts = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(ids)), sizes)
            hit = np.flatnonzero(rank == least[word])
            # of hits side by side (the pair x x in x x x) every second one counts, from the left
            head = np.ones(len(hit), bool)
            head[1:] = (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])
            run = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            sizes = sizes - np.bincount(word[hit], minlength=len(ids))
            sym = sym[~gone]
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words as little-endian unsigned 32-bit integers."""
        order, found = list(words), {}
        batch: list[str] = []
        room = FLAT
        for i, w in enumerate(order):
            batch.append(w)
            room -= 4 * len(w)
            if room <= 0 or i + 1 == len(order):
                for x, ids in zip(batch, self.merge([x.encode() for x in batch]), strict=True):
                    found[x] = ids.astype("<u4").tobytes()
                batch, room = [], FLAT
        return found

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; special strings are their tokens."""
        cut = []
        for text in batch:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            cut.append([(p, None) if i % 2 else ("", self.words.findall(p)) for i, p in enumerate(parts)])
        lists = [words for parts in cut for _, words in parts if words]
        seen = set().union(*lists)
        missing = seen.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.cache = {}
            missing = seen
        self.cache.update(self.learn(missing))
        get = self.cache.__getitem__
        out = []
        for parts in cut:
            out.append(b"".join(b"".join(map(get, words)) if words is not None else np.uint32(self.special[s]).astype("<u4").tobytes() for s, words in parts))
        for w in missing:
            if len(w) > CACHED_BYTES:
                del self.cache[w]
        return out

    def decode(self, batch: list[bytes]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become the replacement character."""
        ids = np.frombuffer(b"".join(batch), "<u4").astype(np.int64)
        length = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], length)
        flat = self.bytes[place].tobytes()
        bounds = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in batch])]).astype(np.int64)]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def load(path: str) -> ByteBpe:
    """The worker's vocabulary of this path, with its cache."""
    own = held.setdefault("bpe", {})
    if path not in own:
        own[path] = ByteBpe(path)
    return own[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text of every document.

    Null and empty texts have no ids and decode to the empty text; null ids and
    repeated rows give a row each; texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoded in _coded(batches, vocabulary):
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 digests in place of ids and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch, ids, decoded in _coded(batches, vocabulary):
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sha(x.encode()) for x in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str]]]:
    for batch in pieces(batches, mb=1, owner="bpe"):
        bpe = load(vocabulary)
        ids = bpe.encode(texts(batch.column(1)))
        yield batch, ids, bpe.decode(ids)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded with the byte-level vocabulary."""
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
