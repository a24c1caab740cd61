from pyspark.sql import functions as F

from tessera.operators import factors as fa
from tessera.sources import files

BIF = """network x {}
variable D { type discrete [ 2 ] { easy, hard }; }
variable G { type discrete [ 3 ] { a, b, c }; }
probability ( D ) { table 0.6, 0.4; }
probability ( G | D ) { (easy) 0.5, 0.3, 0.2; (hard) 0.1, 0.2, 0.7; }
"""


def test_network_round_trips_and_inference(spark):
    net = files.read_bif(BIF)
    assert net.check() and net.edges() == [("D", "G")]
    for again in (files.read_bif(files.write_bif(net)), files.read_network_json(files.write_network_json(net))):
        assert (again.states, again.tables) == (net.states, net.tables)
    post = {r.D: r.v for r in fa.query(net.factors(spark), ["D"], {"G": "c"}).collect()}
    assert abs(post["hard"] - 0.28 / 0.40) < 1e-9
    drawn = files.forward_sample(net, spark, 20_000, 3)
    share = drawn.agg(F.avg((F.col("G") == "c").cast("int"))).first()[0]
    assert abs(share - 0.40) < 0.02


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,\n2,q\n")
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, df.collect())) == [("1", ""), ("2", "q")]
    files.write_csv(df, f"{tmp_path}/out", single=True)
    assert files.read_csv(spark, f"{tmp_path}/out").count() == 2
    (tmp_path / "x.json").write_text('[{"b": 1, "a": "x"}, {"a": null}]')
    got = files.read_json(spark, str(tmp_path / "x.json"))
    assert got.columns == ["a", "b"] and sorted(map(str, got.collect())) == sorted(["Row(a='x', b=1.0)", "Row(a=None, b=None)"])
    assert files.to_html(spark.createDataFrame([("<&",)], "s string")) == "<table><tr><th>s</th></tr><tr><td>&lt;&amp;</td></tr></table>"
    assert files.to_json_rows(got).count() == 2 and len(files.to_records(got, 1)) == 1
