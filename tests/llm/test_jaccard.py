import random
import re

import pytest

from tessera.llm import jaccard
from tessera.llm.components import components
from tessera.llm.jaccard import jaccard_components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, percent=85):
    parent = {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(shingles(t)), None if i is None else root(i)) for i, t, *_ in rows), key=str)


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3)
    rows, i = [], 0
    common = [f"p{k}" for k in range(60)]
    for _ in range(25):
        base = [f"{word()}{r.randint(0, 40)}" for _ in range(r.choice([5, 30, 80, 200]))]
        if r.random() < 0.4:
            base[3:3] = common
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w), "x"))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    rows = near_copies(seed)
    rows += [(900, None, "x"), (901, "", "x"), (902, "a b", "x"), (903, "A  b\n", "x"), (None, rows[0][1], "x"), (904, " \t", "x"), (905, "b a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_without_grouping_all_links_come_from_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LINKS", 0)
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string")
    assert sorted(map(tuple, jaccard_components(docs).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (101, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("percent", [85, 60])
def test_links_are_brute_force(spark, percent):
    rows = [(r[0], r[1]) for r in near_copies(3)]
    rows += [(rows[0][0], rows[1][1]), (None, rows[0][1]), (9001, None), (9002, "")]
    least = {}
    for i, t in rows:
        if i is not None and shingles(t):
            x = frozenset(shingles(t))
            least[x] = min(i, least.get(x, i))
    sets = list(least.items())
    want = {tuple(sorted((i, j))) for k, (x, i) in enumerate(sets) for y, j in sets[:k] if i != j and 100 * len(x & y) >= percent * len(x | y)}
    got = [tuple(r) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3
