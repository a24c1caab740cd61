import random
from collections import Counter
from math import log10

import numpy as np
import pytest

from tessera.llm import trie
from tessera.llm.text import crc_mod
from tessera.llm.trie import D2, D3, STEPS, EliasFano, fit, score


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (5, 2), (1000, 10**3), (3000, 10**7), (3000, 10**12), (500, 2**45)])
def test_elias_fano(n, top):
    r = random.Random(n)
    v = np.array(sorted(r.randint(0, top) for _ in range(n)), np.int64)
    e = EliasFano(EliasFano.parts(v))
    assert e[np.arange(n)].tolist() == v.tolist() if n else True
    asked = np.array([*v, *[r.randint(0, top) for _ in range(50)], top + 1, top * 4 + 7], np.int64)
    got = e.find(asked)
    held = set(v.tolist())
    assert all((g >= 0 and v[g] == a) if a in held else g == -1 for a, g in zip(asked.tolist(), got.tolist(), strict=True))


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0D]+", low) if w] + [None]


def brute(train):
    """The model of all n-grams, without any cut."""
    lists = [tokens(t) for t in train]
    c1 = Counter(w for x in lists for w in x)
    n, v = sum(c1.values()), len(c1)
    grams = lambda k: Counter(tuple(x) for ws in lists for i in range(len(ws)) for x in [([None, *ws])[max(0, i + 2 - k) : i + 2]] if len(x) == k)
    c2, c3 = grams(2), grams(3)
    q = lambda p: 10 ** (-round(-log10(p) * STEPS) / STEPS)
    next1, next2 = Counter(g[0] for g in c2), Counter(g[:2] for g in c3)

    def p1(w):
        return (c1.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))

    def p2(a, w):
        left = q(D2 * next1[a] / c1[a]) if a in next1 else 1
        return q((c2[a, w] - D2) / c1[a] + left * p1(w)) if (a, w) in c2 else left * p1(w)

    def p3(a, b, w):
        left = q(D3 * next2[a, b] / c2[a, b]) if (a, b) in next2 else 1
        return q((c3[a, b, w] - D3) / c2[a, b] + left * p2(b, w)) if (a, b, w) in c3 else left * p2(b, w)

    def of(text):
        ws = [None, *tokens(text)]
        full = sum(log10(p2(ws[0], ws[1]) if i == 1 else p3(*ws[i - 2 : i + 1])) for i in range(1, len(ws)))
        return len(ws) - 1, sum(c1.get(w, 0) > 0 for w in ws[1:]), n, sum(log10(p1(w)) for w in ws[1:]), full

    return of


@pytest.mark.parametrize("shards", [{}, {"text": 5000, "tokens": 400}, {"text": 700, "tokens": 20}])
def test_scores_are_brute_force(spark, shards):
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(30)] + ["Ünder", "THE", "the"]
    line = lambda: " ".join(vocab[min(len(vocab) - 1, int(r.expovariate(0.15)))] for _ in range(r.randint(0, 25)))
    rows = [(i, line() if i % 9 else "the w1 w2 w3 w1 w2 w3", "x") for i in range(250)]
    rows += [(300, None, "x"), (301, "", "x"), (None, "the w1 unseen", "x"), (302, "the " * 3000, "x"), (303, "w1 w2\n\tw3", None), (303, "w1 w2\n\tw3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = docs.filter(crc_mod(docs.doc_id, 10) != 0)
    of = brute([x.text for x in train.collect()])
    got = score(docs, fit(train, **shards)).collect()
    assert len(got) == len(rows)
    by = {(i, t): of(t) for i, t, _ in rows}
    wants = sorted([(i, *by[i, t]) for i, t, _ in rows], key=str)
    for row, want in zip(sorted(map(tuple, got), key=lambda x: str(x[:4])), sorted(wants, key=lambda x: str(x[:4])), strict=True):
        assert row[:4] == want[:4] and row[4] == pytest.approx(want[4], abs=1e-9), (row, want)
        assert row[5] == pytest.approx(want[5], abs=0.06 * row[1]), (row, want)
    assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score(docs, fit(docs.limit(0))).collect()
    assert [(x.n_known, x.train_tokens) for x in got] == [(0, 0), (0, 0)]
    assert score(docs.limit(0), fit(docs)).count() == 0


def test_every_ngram_counts(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"c{r.randint(0, 40)}" for _ in range(30))) for i in range(60)]
    rows += [(100 + k, "seven quiet herons crossed our frozen canal") for k in range(2)] + [(150, "nine old lamps lit one narrow street")]
    rows += [(200, "our frozen seven herons canal crossed quiet"), (201, "old street lit narrow lamps one nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = brute([t for i, t in rows if i < 200])
    got = {x.doc_id: x for x in score(docs, fit(docs.filter("doc_id < 200"))).collect()}
    for i, t in rows:
        want = of(t)
        assert got[i].base_score == pytest.approx(want[3], abs=1e-9)
        assert got[i].score == pytest.approx(want[4], abs=0.06 * got[i].n_tokens), i
    assert got[100].score > got[150].score + 1 and got[100].score > got[200].score + 10 and got[150].score > got[201].score + 2


def test_query(spark, tmp_path):
    rows = [(i, f"a b c{i % 5} the end", "en", "s", 1) for i in range(40)] + [(40, None, None, None, None), (None, "x y", None, None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = trie.op7_lm_scores(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(41)}
    of = brute([t for i, t, *_ in rows if i is not None and not held[i]])
    for x in got.collect():
        assert x.held_out == held.get(x.doc_id, False)
        assert tuple(x)[2:5] == of(dict((r[0], r[1]) for r in rows)[x.doc_id])[:3]
