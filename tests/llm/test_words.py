import random
import re

import pyarrow as pa
import pytest

from tessera.llm import words


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0D]+", low) if w]


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_equal_hashes_for_equal_words_only(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    r = random.Random(chunk)
    known = {}
    for _ in range(200):
        batch = [r.choice([None, "", " ", "a b", "été A", "x" * r.randint(0, 30), " a\nB ", "aa", "a\x0bc d"]) for _ in range(r.randint(0, 6))]
        column = pa.concat_arrays([pa.array(["zz"]), pa.array(batch, pa.string()), pa.array(["q"])]).slice(1, len(batch))
        hashes, counts = words.word_hashes(*words.utf8(column))
        assert counts.tolist() == [len(split(x)) for x in batch]
        for w, h in zip([w for x in batch for w in split(x)], hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
