import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def asked(name, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db.execute(SQL[name]).fetchall()


def test_gram_matrix_sums_over_every_row(spark):
    got = {(r.i0, r.i1): r.v for r in QUERIES["gram_matrix_columns"](spark, SF).collect()}
    want = {r[:2]: r[2] for r in asked("gram_matrix_columns", "embeddings")}
    assert got == pytest.approx(want, abs=2e-5)
    rows = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(rows) > 8 and len(got) == len(rows[0]) ** 2
    assert got[0, 1] == pytest.approx(sum(x[0] * x[1] for x in rows), abs=2e-5)


def test_string_functions_read_whole_texts(spark):
    got = sorted(map(tuple, QUERIES["string_functions_whole"](spark, SF).collect()))
    assert got == sorted(asked("string_functions_whole", "documents"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert max(map(len, text.values())) > 60
    for doc_id, _, n_chars, _, n_bytes, sentences in got:
        x = text[doc_id]
        assert (n_chars, n_bytes, sentences) == (len(x.lower()), len(x.replace("th", "THE").encode()), len(x.split(". ")))


def test_whole_graphs_have_every_row(spark):
    tables = ("lineitem", "orders", "customer", "supplier")
    for name in ("graph_degrees_whole", "graph_distances_whole", "graph_moral_whole", "graph_density_whole"):
        assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == sorted(asked(name, *tables)), name
    line = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.expr("l_orderkey = o_orderkey")).collect()
    edges = {(3 * r.l_partkey, 3 * r.l_suppkey + 1) for r in line} | {(3 * r.l_suppkey + 1, 3 * r.o_custkey + 2) for r in line}
    degrees = QUERIES["graph_degrees_whole"](spark, SF).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert tuple(degrees) == (len(edges), len(edges))
    ends = {v: v for e in edges for v in e}
    while any(ends[a] != ends[b] for a, b in edges):
        for a, b in edges:
            ends[a] = ends[b] = min(ends[a], ends[b])
    assert {r.node: r.component for r in QUERIES["graph_components_whole"](spark, SF).collect()} == ends
    ranks = [r[1] for r in QUERIES["graph_pagerank_whole"](spark, SF).collect()]
    assert len(ranks) == len(ends) and sum(ranks) == pytest.approx(1, abs=1e-5)
