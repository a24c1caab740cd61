import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.quality import BITS, KneserNey, discounts, ngram_codes, score_quality, text_facts

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_facts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\v\x1c  é#|"), max_size=60))
def test_facts(text):
    assert text_facts(text) == brute_facts(text)


def brute_kn(counts, order):
    """Plain recursive interpolated modified Kneser-Ney over tuples."""
    levels = [counts]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]
    d = [discounts(np.array(list(x.values()))) for x in levels]

    def p(g):
        if not g:
            return 1 / (1 << BITS)
        level, dd = levels[len(g) - 1], d[len(g) - 1]
        after = {h: n for h, n in level.items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        n = level.get(g, 0)
        return (n - dd[min(n, 3)]) / total + sum(dd[min(x, 3)] for x in after.values()) / total * p(g[1:])

    return p


def test_model_is_kneser_ney():
    text = "the cat sat on the mat. the rat ate that hat " * 2 + "a dog"
    order = 3
    codes, _ = ngram_codes([text], order)
    code, n = np.unique(codes, return_counts=True)
    model = KneserNey.fit(order, {"x": (code, n.astype(np.int64))})
    split = lambda c: tuple(int(c) >> BITS * k & 31 for k in (2, 1, 0))
    p = brute_kn(Counter({split(c): int(k) for c, k in zip(code, n, strict=True)}), order)
    asked = np.array([a << 10 | b << 5 | c for a, b, c in itertools.product([0, 1, 20, 8, 7], [0, 5, 20, 31], range(32))], np.uint32)
    got = np.exp(model.log_p(0, asked))
    assert np.allclose(got, [p(split(c)) for c in asked], rtol=1e-5)
    assert np.allclose(got.reshape(-1, 32).sum(1), 1, atol=1e-5)


def test_frames(spark):
    rows = [(i, " ".join(f"w{(i * k) % 89}x" for k in range(80)), "en", 1) for i in range(1, 40)]
    rows += [(50, None, "en", 1), (51, "", None, 1), (None, "one two", None, 1), (52, "### $$$ " * 60 + rows[3][1], "en", 1), (1, rows[0][1], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = score_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        want = brute_facts(text)
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert score_quality(docs.limit(0)).count() == 0
    assert score_quality(docs.filter("doc_id = 50")).first().perplexity is None


def test_estimates_leave_each_occurrence_out(spark):
    from tessera.llm.quality import ORDER, left_out

    texts = ["the cat sat on the mat. The rat ate that hat", "\U0001f600\U0001f601 abc ж Ж a 1 2", "the cat sat", ""]
    grams = Counter(tuple((" " * (ORDER - 1) + t)[i : i + ORDER]) for t in texts for i in range(len(t)))

    def levels_of(counts):
        levels = [counts]
        for _ in range(ORDER - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        return levels[::-1]

    d = [discounts(np.array(list(x.values()))) for x in levels_of(grams)]

    def p(levels, g):
        if not g:
            return 1 / 0x110000
        dd = d[len(g) - 1]
        after = [n for h, n in levels[len(g) - 1].items() if h[:-1] == g[:-1]]
        if not after:
            return p(levels, g[1:])
        n = levels[len(g) - 1].get(g, 0)
        return (n - dd[min(n, 3)]) / sum(after) + sum(dd[min(x, 3)] for x in after) / sum(after) * p(levels, g[1:])

    docs = spark.createDataFrame([(t, "=en") for t in texts], "text string, lang string")
    got = {tuple(bytes(r.gram).decode("utf-32-le")): r.q for r in left_out(docs).collect()}
    assert got.keys() == grams.keys()
    for g in grams:
        assert np.isclose(got[g], p(levels_of(Counter({h: n - (h == g) for h, n in grams.items() if n > (h == g)})), g), rtol=1e-9), g


def test_junk_of_ordinary_shape_leaves_the_band(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choices("етаоинрслвкдмпу", k=r.randint(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(words, k=80)), "ru") for i in range(120)]
    # small letters 26 code points apart, which no other text has
    rows.append((500, rows[0][1].translate({c: c + 26 for c in range(0x430, 0x446)}), "ru"))
    got = {x.doc_id: x for x in score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[500].base_failed and not got[500].kept
    assert got[500].perplexity > 10 * got[0].perplexity and sum(got[i].kept for i in range(120)) > 100
