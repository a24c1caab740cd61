import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.bpe import ByteBpe, encode_digests, encode_documents
from tessera.llm.token_count import PieceCounter, count_tokens, pretokens

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
own, theirs = ByteBpe(JSON), Tokenizer.from_file(JSON)
counter, piece = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n\n a\t\tb ", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y ", "<s></s><unk>",
    "▁", " ▁ a▁▁b", "don't we'll I'm", "naïve café 東京 123 ½ ²³ ٣", "\x00\x01\x1c\x1d\x1e\x1f\x85᠎ 　", "😀👩‍👩‍👧", "ab" * 5000, "the " * 3000, "x" * 3000,
]


def same(texts):
    ids = own.encode(texts)
    want = [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert own.decode(ids) == [theirs.decode(x, skip_special_tokens=False) for x in want]
    assert counter.count([pretokens(x) for x in texts]) == [len(x) for x in piece.encode(texts)]


def test_odd_texts():
    same(ODD)


def test_every_character():
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    same(["".join(f"a{c}1{c}-{c} {c}{c}" for c in every[i : i + 64]) for i in range(0, len(every), 64)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\tthe'sandor▁"))), max_size=4))
def test_any_text(texts):
    same(texts)


def test_frames(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, None), (1, "a", "clash"), (1, "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_digests(docs, JSON).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.doc_id: r.decoded for r in encode_documents(docs, JSON).collect()}[7] == ODD[7]
    got = count_tokens(docs, MODEL, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(piece.encode(t or "")), n > 100) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_digests(none, JSON).count() == 0
    assert count_tokens(none, MODEL).count() == 0
