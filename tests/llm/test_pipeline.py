"""The pipeline's stages against plain Python, each on its own input."""

import random

import corpus_pipeline
from corpus_pipeline import STAGES
from tests.llm.test_jaccard import shingles
from tests.llm.test_substrings import brute as brute_removal

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    parts = {"aa": ["the", "tion", "ing", "oth"], "bb": ["sch", "keit", "und", "ü"]}
    words = lambda lang, n: ["".join(r.choices(parts[lang], k=r.randint(1, 3))) for _ in range(n)]
    shared = " ".join(words("aa", 20))
    rows = []
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        w = words(lang, r.choice([4, 30, 90]))
        if i % 7 == 0:
            w += [shared]
        if i % 5 == 4:
            w = rows[i - 3][1].split(" ")
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), lang, f"s{i % 3}", 0))
    rows += [(100, None, "aa", "s1", 0), (101, "", "aa", None, 0), (102, "漢字仮名交じり文", None, "s2", 0), (103, rows[1][1], None, None, None), (None, " ".join(words("aa", 40)), "aa", "s1", 0)]
    return rows


def near(rows):
    sets = {i: shingles(t, 5) for i, t, *_ in rows if i is not None}
    group = {i: {i} for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                both = group[i] | group[j]
                for k in both:
                    group[k] = both
    return sorted((r for r in rows if r[0] is None or min(group[r[0]]) == r[0]), key=str)


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    take = lambda df: sorted(map(tuple, df.collect()), key=str)
    stage = dict(STAGES)
    kept = stage["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r[0] for r in corpus()} - {r[0] for r in take(kept)} == {100, 101, 102}
    rows = take(kept)
    kept = spark.createDataFrame(rows, COLUMNS)
    once = stage["near_duplicates"](spark, kept, "")
    assert take(once) == near(rows)
    rows = take(once)
    once = spark.createDataFrame(rows, COLUMNS)
    cut = stage["substring_dedup"](spark, once, "")
    left = {i: k.decode("utf-8", "ignore") for i, k, *_ in brute_removal(rows)}
    assert {r[0]: r[1] for r in take(cut)} == left and len(take(cut)) == len(rows)
    assert all(len(r[1]) == r[4] for r in take(cut)) and any(len(left[r[0]]) < len(r[1]) for r in rows)
    rows = take(cut)
    cut = spark.createDataFrame(rows, COLUMNS)
    mixed = take(stage["mix"](spark, cut, ""))
    assert set(mixed) <= set(rows) and len(mixed) > len(set(mixed))
    assert mixed == take(stage["mix"](spark, cut, ""))
    out = stage["bpe"](spark, spark.createDataFrame(mixed, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.decoded) for r in out if r.doc_id is not None) == sorted((r[0], r[1]) for r in mixed if r[0] is not None)


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, f in STAGES:
        docs = f(spark, docs, str(tmp_path))
    ids = lambda df: sorted((str(r.doc_id), r.n_tokens) for r in df.collect())
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(docs)
