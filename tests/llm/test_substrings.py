import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.substrings import WIDTH, Suffixes, _held, remove_repeats, segments


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    holder = {}
    for i, b in texts:
        for k in range(len(b) - WIDTH + 1):
            if i is not None:
                s = b[k : k + WIDTH]
                holder[s] = min(holder.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, np.int8)
        for k in range(len(b) - WIDTH + 1):
            if i is not None and holder[b[k : k + WIDTH]] < i:
                gone[k + 1 : k + 1 + WIDTH] = 1
        left = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, left, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum())))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices(["ab", "c", "dé", " ", "x\n"], k=n))
    passages = [text(40) for _ in range(4)]
    rows = []
    for i in range(60):
        t = "".join(r.choice([text(r.randint(0, 60)), r.choice(passages), r.choice(passages)[: r.randint(20, 60)]]) for _ in range(r.randint(0, 4)))
        if rows and r.random() < 0.3:
            t = rows[r.randrange(len(rows))][1]
            t = t[: len(t) // 2] + r.choice(["", "!"]) + t[len(t) // 2 :]
        rows.append((i * 7 % 61, t, "x"))
    return rows


@pytest.mark.parametrize(("seed", "range_bytes"), [(1, 10**6), (2, 300), (3, 2000)])
def test_removal_is_brute_force(spark, seed, range_bytes):
    rows = corpus(seed)
    rows += [(500, None, "x"), (501, "", "x"), (502, "a" * 300, "x"), (503, "a" * 49, "x"), (504, "a" * 50, "x"), (None, "a" * 80, "x"), (505, rows[5][1], "x"), (505, rows[5][1], "x"), (506, "ü" * 40, "x"), (507, "ü" * 30, "x")]
    rows += [(508, "the same id" * 9, "x"), (508, "another text" * 9, "x"), (509, "the same id" * 7 + "another text" * 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_spans string")
    got = remove_repeats(docs, range_bytes=range_bytes).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(((i, bytes(k), *x) for i, k, *x in got), key=str) == brute(rows)


@pytest.mark.parametrize("letters", [b"a", b"ab", bytes(range(250))])
def test_suffixes_are_sorted(letters, monkeypatch):
    r = random.Random(3)
    block = bytes(r.choices(letters, k=90))
    flat = b"".join(block[r.randrange(60) :] + bytes(r.choices(letters, k=r.randrange(9))) for _ in range(80)) + b"z" * WIDTH
    places = np.array([k for k in range(len(flat) - WIDTH) if r.random() < 0.8])
    s = Suffixes(flat, places)
    new = s.sort()
    keys = [flat[p : p + WIDTH] for p in places[s.order]]
    assert sorted(s.order.tolist()) == list(range(len(places)))
    assert keys == sorted(keys)
    assert new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:], strict=False)]


def test_every_start_is_in_one_segment():
    r = random.Random(4)
    docs = [bytes(r.choices(b"ab", k=n)) for n in (0, 49, 50, 51, 300, 120)]
    anchor, doc, first, last = segments(np.frombuffer(b"".join(docs), np.uint8), np.array([len(x) for x in docs]))
    starts = [k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)]
    begin = np.cumsum([0, *map(len, docs)])
    assert starts == [begin[d] + k for d, x in enumerate(docs) for k in range(len(x) - WIDTH + 1)]
    flat = b"".join(docs)
    by = {}
    for k, a, b in zip(anchor.tolist(), first, last, strict=True):
        for s in range(a, b + 1):
            assert by.setdefault(flat[s : s + WIDTH], k) == k
    assert len(segments(np.full(100_000, 97, np.uint8), np.array([100_000]))[0]) == 1


def test_rounds_do_not_grow_with_the_largest_group(monkeypatch):
    """A hot passage with 1,900 different surroundings: the size of its group grows with the input."""
    r = random.Random(5)
    flat = b"".join(b"a passage that very many documents have " + bytes(r.choices(range(97, 123), k=30)) for _ in range(1900))
    calls, word = [], Suffixes.word
    monkeypatch.setattr(Suffixes, "word", lambda self, *a: calls.append(1) or word(self, *a))
    s = Suffixes(flat, np.arange(1900) * 70)
    new = s.sort()
    keys = [flat[p : p + WIDTH] for p in s.places[s.order]]
    assert keys == sorted(keys)
    assert new.sum() == len(set(keys))
    assert len(calls) < 1000


def test_batches_sent_do_not_grow_with_the_ranges():
    r = random.Random(6)
    texts = ["".join(r.choices("abcdefgh", k=2000)) for _ in range(50)]
    every, none = (SimpleNamespace(value=SimpleNamespace(contains=f)) for f in (lambda x: np.ones(len(x), bool), lambda x: np.zeros(len(x), bool)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array(texts)], ["doc_id", "row", "text"])
    n = 1000
    sent = list(_held(SimpleNamespace(mapInArrow=lambda f, schema: f), none, every, n)(iter([rows])))
    got = []
    for batch in sent:
        for row in batch.to_pylist():
            low, high, size = (np.frombuffer(row[c], np.int64) for c in "cde")
            key, text = np.frombuffer(row["a"], np.uint32), row["f"]
            assert len(key) == len(size) == len(low) and size.sum() == len(text) and (low == high).all()
            for k, d, a, b in zip(key.tolist(), low.tolist(), np.cumsum(size) - size, np.cumsum(size), strict=True):
                got.append((row["s"], k, d, text[a:b]))
    flat = "".join(texts).encode()
    key, doc, first, last = segments(np.frombuffer(flat, np.uint8), np.full(50, 2000))
    want = [((k >> 32) * n >> 32, k & 0xFFFFFFFF, d, flat[a : b + WIDTH]) for k, d, a, b in zip(key.tolist(), doc.tolist(), first, last, strict=True)]
    assert sorted(got) == sorted(set(want))
    assert len(sent) < 20


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
