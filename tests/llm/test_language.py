import random
import zlib

import numpy as np

from tessera.llm.language import Centroids, features, fit_languages, identify, weigh
from tessera.llm.text import crc_mod
from pyspark.sql import functions as F

PARTS = {"aa": ["the", "tion", "ing", "oth", "er"], "bb": ["sch", "keit", "und", "ver", "ü"], "cc": ["мир", "ов", "ский", "да"]}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(PARTS[lang], k=3)) for _ in range(n))


def rows(n=150):
    return [(i, text(x, 5 + i % 40, i), x, "s") for i in range(n) for x in [list(PARTS)[i % 3]]]


def test_accuracy_rejection_and_edges(spark):
    odd = [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 -- 34!", "bb", "s"), (None, text("bb", 20, 1), None, None), (1003, "漢字仮名交じり文の例文です", "aa", "s")]
    odd += [(1004, text("cc", 20_000, 5), None, "s"), (1005, text("aa", 30, 7), "aa", "s"), (1005, text("aa", 30, 7), "aa", "s")]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, score string")
    model = fit_languages(docs.filter(crc_mod(F.col("doc_id"), 5) != 0).filter("doc_id < 1000"), per_language=30)
    out = identify(docs, model).collect()
    assert len(out) == 158 and out[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == by[i].lang and not by[i].rejected for i in range(150))
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "bb" and by[1004].lang_pred == "cc" and by[1003].rejected
    assert all(0 <= r.score <= 1 for r in out)


def test_nearest_is_brute_force():
    found = [features(r[1]) for r in rows()]
    counts, sizes = np.stack([c for c, _ in found]), np.array([n for _, n in found])
    model = Centroids.fit([r[2] for r in rows()], counts, sizes)
    w = weigh(counts, model.idf).astype(float)
    for row, name, score in zip(w, *model.nearest(counts, sizes)[:2], strict=True):
        cos = [float(row @ c) / float(np.linalg.norm(row) * np.linalg.norm(c)) for c in model.rows.astype(float)]
        assert abs(max(cos) - score) < 1e-5 and model.names[int(np.argmax(cos))] == name


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert fit_languages(docs) is None
    assert {(r.doc_id, r.lang_pred) for r in identify(docs, None).collect()} == {(1, "und"), (2, "und")}
    assert identify(docs.limit(0), None).count() == 0
