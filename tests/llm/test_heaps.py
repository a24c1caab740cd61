"""Every stage of the pipeline starts from executors whose heaps were trimmed, in a cluster of two executor processes."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[2]

SCRIPT = '''
import time
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from corpus_pipeline import STAGES

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.executor.extraJavaOptions": "-XX:+UseG1GC", "spark.executor.heartbeatInterval": "300ms", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")


def full_collections():
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    own = [found.apply(i) for i in range(found.size())]
    return {x.id(): x.peakMemoryMetrics().get().getMetricValue("MajorGCCount") for x in own if x.id() != "driver" and x.peakMemoryMetrics().isDefined()}


def until(holds):
    for _ in range(40):
        if holds():
            return True
        time.sleep(0.2)
    return False


spark.range(0, 8, 1, 8).count()
assert until(lambda: len(full_collections()) == 2)
for name, stage in STAGES:
    time.sleep(1)
    before = full_collections()
    try:
        stage(spark, spark.range(1), "")  # without texts a stage ends where it first asks for them
    except AnalysisException:
        pass
    print("HEAPS", name, until(lambda: all(n > before[x] for x, n in full_collections().items())), before, full_collections(), flush=True)
spark.stop()
'''


def test_stages_start_from_trimmed_heaps(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors work below Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x.split(maxsplit=3) for x in done.stdout.splitlines() if x.startswith("HEAPS")]
    assert [x[1] for x in said] == ["language_id", "near_duplicates", "substring_dedup", "mix", "bpe"], done.stderr[-2000:]
    assert all(x[2] == "True" for x in said), said
