import numpy as np

from tessera.llm import neighbours
from tessera.llm.neighbours import build_index, chi_square_quantile, leaf_bounds, search, tree_order

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted((-float((q * x).sum()), j) for j, x in good if j != i and len(x) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(spark, rows, k=20):
    vectors = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in search(build_index(vectors, k), vectors.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    g = np.random.default_rng(1)
    centre = g.standard_normal((12, 24))
    rows = [(i, (centre[i % 12] + 0.7 * g.standard_normal(24)).tolist(), "x") for i in range(3000)]
    got, want = found(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        exact = dict(brute_scores(rows, q))
        assert all(abs(exact[j] - s) < 1e-12 for j, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def brute_scores(rows, q):
    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    return [(j, float((x[q] * v).sum())) for j, v in x.items()]


def test_edges(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same, None) for i in range(0, 90)] + [(100, [1.0, 2.0, 0.6], None), (120, [3.0, 1.0], None), (121, [1.0, 1.0], None)]
    rows += [(200, None, None), (220, [0.0, 0.0, 0.0], None), (240, [1.0, None, 2.0], None), (260, [float("nan"), 1.0, 1.0], None), (280, [float("inf"), 1.0, 1.0], None), (None, same, None), (300, [], None)]
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, []) == {}
    assert found(spark, rows[:2]) == {0: [(1, 5.25)]}


def test_pieces():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    p = np.random.default_rng(2).standard_normal((1000, 8))
    leaves = tree_order(p)
    assert np.cumsum([len(x) for x in leaves]).tolist() == leaf_bounds(1000)[1:].tolist()
    assert sorted(np.concatenate(leaves)) == list(range(1000))


def test_ties_of_distinct_vectors_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 512)
    g = np.random.default_rng(5)
    seen = np.unique(g.integers(-1, 2, (4000, 7)), axis=0)
    seen = seen[(seen != 0).any(1)]
    ids = g.permutation(len(seen)) * 3
    rows = [(int(i), [float(c) for c in v], None) for i, v in zip(ids, seen, strict=True)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in search(build_index(vectors), vectors.filter("vec_id % 20 = 0"), sure=0.9999999).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(rows) > 1500 and got == brute(rows, 20)


def test_far_parts_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 256)
    g = np.random.default_rng(6)
    centre = g.standard_normal((16, 24)) * 4
    rows = [(i, (centre[i % 16] + 0.1 * g.standard_normal(24)).tolist(), None) for i in range(4000)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = build_index(vectors)
    parts = [r.asDict() for r in index.parts.collect()]
    assert len(parts) >= 16 and sum(p["n"] for p in parts) == 4000
    got = search(index, vectors.filter("vec_id % 20 = 0"))
    assert got.count() == 200 * 20
    want = brute(rows, 20)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got.collect())
    assert hits >= 0.9 * 4000


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, [float(i % 7), 1.0], 0) for i in range(45)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours.op3_neighbours(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert {r.query_id for r in got.collect()} == {0, 20, 40}
