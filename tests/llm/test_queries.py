"""The queries of the subpackage on small tables with nulls, repeats, empty texts and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm import queries

KINDS = {
    "op1_quality": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op2_mix_sources": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op4_language": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op5_substrings": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op6_token_counts": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
    "op9_jaccard": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
    "op10_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
}


def rows():
    r = np.random.default_rng(3)
    parts = {"aa": ["the", "tion", "ing", "oth"], "bb": ["sch", "keit", "und", "zu"]}
    out = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(r.choice(parts[lang], r.integers(1, 4))) for _ in range(int(r.integers(1, 120)))]
        out.append((i, " ".join(words), lang, f"s{i % 3}", len(words), "extra"))
    out += [(100, None, None, None, None, "x"), (101, "", "aa", "s1", 0, "x"), (102, " \t\n", "bb", None, 3, None), (103, out[5][1], "aa", "s2", 1, "x"), (103, out[5][1], "aa", "s2", 1, "x")]
    return [*out, (None, "no id #here", "aa", "s0", 1, "x"), (104, "Ünïcödé <b> word " * 60 + "\nline\nline\n\n", "bb", "s0", 1, "x")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/empty/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", KINDS)
def test_columns_and_rows(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    assert [c for c in got.dtypes if c[0] in dict(KINDS[name])] == [c for c in got.dtypes if c in KINDS[name]]
    assert set(KINDS[name]) <= set(got.dtypes)
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted((r[0] for r in rows()), key=str)


@pytest.mark.parametrize("name", KINDS)
def test_empty_table(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


def test_quality_base(spark, folder):
    text = {r[0]: r[1] for r in rows()}
    for r in queries.QUERIES["op1_quality"](spark, folder).collect():
        whole = text[r.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0d]+", whole)
        windows = {}
        for k in range(len(words) - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        seen, dups = set(), 0
        for line in whole.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dups += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in whole), dups, len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_language_split(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op4_language"](spark, folder).collect()}
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert all(got[i].lang_pred == "und" for i in (100, 101, 102))
    known = [(got[i].lang_pred, lang) for i, t, lang, *_ in rows() if i is not None and i < 80 and len(t) > 100]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_digests(spark, folder):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    text = {r[0]: r[1] or "" for r in rows()}
    bpe = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for r in queries.QUERIES["op10_bpe"](spark, folder).collect():
        ids = bpe.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    piece = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for r in queries.QUERIES["op6_token_counts"](spark, folder).collect():
        n = len(piece.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 4096)
    for r in queries.QUERIES["op5_substrings"](spark, folder).collect():
        if r.n_removed == 0:
            assert r.kept_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.n_removed for r in queries.QUERIES["op5_substrings"](spark, folder).collect() if r.doc_id == 103} == {103: len(text[5].encode())}
