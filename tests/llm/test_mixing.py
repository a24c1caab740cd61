import random
from fractions import Fraction

import pytest

from tessera.llm.mixing import mix_documents, mix_plan

SCHEMA = "doc_id long, text string, source string, size string"


def rows(seed):
    r = random.Random(seed)
    out = [(i, " ".join(["w"] * int(r.lognormvariate(2, 1))), f"s{int(r.random() ** 3 * 6)}", "x") for i in range(400)]
    return out + [(500, None, "s0", "x"), (501, "", None, "x"), (502, "a b c", None, "x"), (None, "a b", "s0", "x"), (3, "w w", "s1", "x"), (3, "w w", "s1", "x"), (503, None, "empty", "x")]


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: float(share.get(s, 2 * sizes[s])) for s in names}
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_plan(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame(data, SCHEMA)
    got = mix_plan(docs).collect()
    assert len(got) == len(data)
    sizes, taken, longest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix_plan(docs.repartition(7)).collect()))


def test_documents(spark):
    docs = spark.createDataFrame(rows(3), SCHEMA)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    n = sum(r.copies for r in mix_plan(docs).collect())
    assert mixed.count() == n and mix_documents(docs.limit(0)).count() == 0
