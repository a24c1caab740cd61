"""Quality rules: counts of words and repetition, and perplexity bands of each language.

The language model has n-grams of five characters as they are (code points) with
modified Kneser-Ney smoothing (interpolated, three discounts an order). Spark
counts them over all documents and derives the lower orders by aggregates and
joins, so the model grows with the corpus at one order. As the documents scored
are those counted, each occurrence has the estimate of the counts without itself;
else a junk text would be predicted from its own n-grams. The estimates lie in
sorted arrays of 64-bit hashes, in shards that workers map from the shared
folder and search by bisection.

A document's perplexity is that of its words: exp(-ln P(text) / words).
Of each language, the logarithms' quartiles q1 and q3 give the band from
``q1 - width * (q3 - q1)`` to ``q3 + width * (q3 - q1)``; documents outside it,
too surprising or too predictable, are rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import pieces, texts
from tessera.llm.trie import map_level, write_level
from tessera.sources.shared import cut, fresh_path
from tessera.sources.tables import table

#: Bits of a character class in :class:`KneserNey`, which holds small models in memory; characters of an n-gram of the corpus model.
BITS, ORDER = 5, 5
#: Entries of a shard; places of a worker's memo.
SHARD, MEMO = 1_000_000, 1 << 21
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"

FACTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_p double"


@cache
def classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1-26 small letters without accents, 27 digits, 28 stops, 29 capitals, 30 other letters, 31 the rest."""
    out = np.full(0x110000, 31, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        base = unicodedata.normalize("NFD", x)[0]
        if x.isspace():
            out[c] = 0
        elif x.isupper():
            out[c] = 29
        elif "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif x == "ß":
            out[c] = 19
        elif x.isdigit():
            out[c] = 27
        elif x in ".,;:?":
            out[c] = 28
        elif x.isalpha():
            out[c] = 1 + c % 26 if c > 0x24F else 30
    return out


def ngram_codes(batch: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-gram that ends at each character of each text, and the texts' lengths; a text begins after white space."""
    pad = " " * (order - 1)
    flat = classes()[np.frombuffer((pad + pad.join(batch)).encode("utf-32-le"), np.uint32)].astype(np.uint32)
    sizes = np.array([len(x) for x in batch], np.int64)
    codes = np.zeros(len(flat), np.uint32)
    for back in range(order):
        codes[order - 1 :] |= flat[order - 1 - back : len(flat) - back] << np.uint32(BITS * back)
    at = np.arange(sizes.sum()) + np.repeat((order - 1) * np.arange(1, len(batch) + 1), sizes)
    return codes[at], sizes


def hashes(language: int, order: int, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (order 1 and up) or, with a negative order, of contexts."""
    x = codes.astype(np.uint64) + np.uint64((language << 40) + ((order + 16) << 32))
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more by the counts of counts."""
    return discounts_of(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5])


def discounts_of(n: np.ndarray) -> np.ndarray:
    """As :func:`discounts`, from the numbers of counts 1, 2, 3 and 4."""
    n = np.asarray(n, float)
    if not n.all():
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(d, 0.05, [0.95, 1.95, 2.95])])


class KneserNey:
    """Estimates of all languages in two sorted hash arrays (n-grams and contexts in one), with log values."""

    def __init__(self, order: int, languages: list[str], keys: np.ndarray, values: np.ndarray):
        self.order, self.languages, self.keys, self.values = order, languages, keys, values

    @staticmethod
    def fit(order: int, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> "KneserNey":
        """From the codes (sorted, distinct) and counts of the highest order of each language."""
        keys, values = [], []
        for i, name in enumerate(sorted(counted)):
            levels = [counted[name]]
            for k in range(order - 1, 0, -1):
                below, n = np.unique(levels[-1][0] & np.uint32((1 << BITS * k) - 1), return_counts=True)
                levels.append((below, n.astype(np.int64)))
            lower = np.full(1, 1 / (1 << BITS))
            lower_codes = np.zeros(1, np.uint32)
            for k, (codes, n) in enumerate(reversed(levels), 1):
                d = discounts(n)
                context = codes >> np.uint32(BITS)
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                spread = np.diff(np.append(first, len(codes)))
                total = np.add.reduceat(n, first).astype(float)
                cutoff = d[np.minimum(n, 3)]
                weight = np.add.reduceat(cutoff, first) / total
                at = np.searchsorted(lower_codes, codes & np.uint32((1 << BITS * (k - 1)) - 1))
                p = (n - cutoff) / np.repeat(total, spread) + np.repeat(weight, spread) * lower[at]
                keys += [hashes(i, k, codes), hashes(i, -k, context[first])]
                values += [np.log(p), np.log(weight)]
                lower, lower_codes = p, codes
        k, v = np.concatenate([*keys, np.empty(0, np.uint64)]), np.concatenate([*values, np.empty(0)])
        at = np.argsort(k)
        return KneserNey(order, sorted(counted), k[at], v[at].astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of hashes, NaN where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at].astype(float), np.nan)

    def log_p(self, language: int, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """ln P(last symbol | the symbols before it) of n-gram codes."""
        k = self.order if order is None else order
        if k == 0:
            return np.full(len(codes), -BITS * np.log(2))
        out = self.find(hashes(language, k, codes))
        lost = np.flatnonzero(np.isnan(out))
        if len(lost):
            back = np.nan_to_num(self.find(hashes(language, -k, codes[lost] >> np.uint32(BITS))), nan=0.0)
            out[lost] = back + self.log_p(language, codes[lost] & np.uint32((1 << BITS * (k - 1)) - 1), k - 1)
        return out


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    three = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    twice = np.zeros(len(three), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(three)] |= twice
    return int(covered.sum())


def text_facts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def gram_hashes(chars: Sequence[np.ndarray], seeds: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of n-grams from their five code points of 21 bits and their language's seed."""
    a, b, c, d, e = (x.astype(np.uint64) for x in chars)
    by = np.uint64(21)
    first = spread(((a << by | b) << by | c) ^ seeds)
    with np.errstate(over="ignore"):
        return spread(first + (d << by | e))


def gram_places(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts behind blanks, where the n-gram that ends at each character begins, and the texts' lengths."""
    pad = " " * (ORDER - 1)
    flat = np.frombuffer((pad + pad.join(batch)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in batch], np.int64)
    return flat, np.arange(sizes.sum()) + np.repeat((ORDER - 1) * np.arange(len(batch)), sizes), sizes


def by_language(batch: pa.RecordBatch, text: int, lang: int) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Each language of a batch, its rows and their texts."""
    whole, names = texts(batch.column(text)), batch.column(lang).to_pylist()
    own: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        own.setdefault(name, []).append(i)
    for name, at in own.items():
        yield name, np.array(at), [whole[i] for i in at]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams over all documents; a gram is its code points, four bytes each."""

    def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        return keys[first], grams[first], np.bincount(back, n).astype(np.int64)

    def rows(lang: str, part: tuple) -> Iterator[pa.RecordBatch]:
        _, grams, n = part
        for a in range(0, len(n), 100_000):
            own = np.ascontiguousarray(grams[a : a + 100_000])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(own), [None, pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), packed.cast(pa.binary()), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size = 0
        for batch in pieces(batches, mb=4):
            for lang, _, group in by_language(batch, 0, 1):
                flat, at, _ = gram_places(group)
                h = gram_hashes([flat[at + k] for k in range(ORDER)], seed(lang))
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                where = at[order[first]]
                held.setdefault(lang, []).append((h[first], flat[where[:, None] + np.arange(ORDER)], np.diff(np.append(first, len(h)))))
                size += len(first)
            if size > 2_000_000:
                held = {lang: [summed(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > 1_000_000:
                    for lang, parts in held.items():
                        yield from rows(lang, parts[0])
                    held, size = {}, 0
        for lang, parts in held.items():
            yield from rows(lang, summed(parts))

    got = docs.select("text", "lang").mapInArrow(run, "lang string, gram binary, n long")
    return got.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def left_out(docs: DataFrame) -> DataFrame:
    """(lang, gram, q): the Kneser-Ney probability of each n-gram's last character without one occurrence of the n-gram.

    The occurrence leaves the count of the n-gram and, where it is the only one,
    the number of different characters before its last four, and so on down.
    """
    spark = docs.sparkSession
    levels = [cut(count_ngrams(docs), "kn-counts")]
    for k in range(ORDER - 1, 0, -1):
        below = levels[-1].groupBy("lang", F.substring("gram", 5, 4 * k).alias("gram"))
        levels.append(cut(below.agg(F.count(F.lit(1)).alias("n")), "kn-counts"))
    low = None
    for k, level in enumerate(reversed(levels), 1):
        of = level.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
        ds = spark.createDataFrame([(r[0], *map(float, discounts_of(r[1:])[1:])) for r in of], "lang string, d1 double, d2 double, d3 double")
        d = lambda c: F.when(c <= 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        n, total, mass = F.col("n"), F.col("total"), F.col("mass")
        rows = level.join(F.broadcast(ds), "lang").withColumn("context", F.substring("gram", 1, 4 * (k - 1)))  # one row for each language
        rows = rows.join(rows.groupBy("lang", "context").agg(F.sum(n).alias("total"), F.sum(d(n)).alias("mass")), ["lang", "context"])
        if low is None:
            rows = rows.withColumns({"lp": F.lit(1 / 0x110000), "lq": F.lit(1 / 0x110000)})
        else:
            rows = rows.withColumn("rest", F.substring("gram", 5, 4 * (k - 1)))
            rows = rows.join(low.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lp"), F.col("q").alias("lq")), ["lang", "rest"])
        p = (n - d(n)) / total + mass / total * F.col("lp")
        lower = F.when(n == 1, F.col("lq")).otherwise(F.col("lp"))
        q = (n - 1 - d(n - 1)) / (total - 1) + (mass - d(n) + d(n - 1)) / (total - 1) * lower
        low = cut(rows.select("lang", "gram", p.alias("p"), F.when(total == 1, lower).otherwise(q).alias("q")), "kn-level")
    return low.select("lang", "gram", "q")


class Estimates:
    """ln q of n-grams by hash in shards, mapped when first needed, with a worker's memo."""

    def __init__(self, paths: list[str | None]):
        self.paths = paths
        self._start()

    def _start(self) -> None:
        self.opened: dict[int, dict[str, np.ndarray]] = {}
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def __getstate__(self):
        return {"paths": self.paths}

    def __setstate__(self, state):
        self.paths = state["paths"]
        self._start()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of distinct hashes; every n-gram of a counted text is there."""
        out = np.full(len(keys), np.nan, np.float32)
        shard = (keys >> np.uint64(1)).astype(np.int64) % max(len(self.paths), 1)
        for s in np.unique(shard).tolist():
            if self.paths[s] is None:
                continue
            if s not in self.opened:
                self.opened[s] = map_level(self.paths[s])
            a, own = self.opened[s], np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(a["hash"], keys[own]), len(a["hash"]) - 1)
            hit = a["hash"][at] == keys[own]
            out[own[hit]] = a["value"][at[hit]]
        if np.isnan(out).any():
            raise ValueError("a text has n-grams that were not counted: the documents changed between two reads")
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of hashes that repeat."""
        if not len(self.keys):
            self.keys, self.values = np.zeros(MEMO, np.uint64), np.full(MEMO, np.nan, np.float32)
        place = (keys & np.uint64(MEMO - 1)).astype(np.int64)
        out = self.values[place]
        new = np.flatnonzero((self.keys[place] != keys) | np.isnan(out))
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            found = self.find(distinct)
            out[new] = found[back]
            place, last = np.unique((distinct & np.uint64(MEMO - 1)).astype(np.int64), return_index=True)
            self.keys[place], self.values[place] = distinct[last], found[last]
        return out


def fit_perplexity(docs: DataFrame, shard: int = SHARD) -> Estimates:
    """The model of ``docs`` (text, lang without nulls)."""
    folder = fresh_path(docs.sparkSession, "kn")
    grams = left_out(docs)
    n = 1 + grams.count() // shard

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds: dict[str, np.uint64] = {}
            names = batch.column(0).to_pylist()
            for x in set(names):
                seeds[x] = seed(x)
            chars = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, ORDER)
            h = gram_hashes(chars.T, np.array([seeds[x] for x in names], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2)], ["key", "v"])

    def write(key: tuple, group: pa.Table) -> pa.Table:
        h, v = group.column("key").to_numpy().view(np.uint64), group.column("v").to_numpy()
        by = np.argsort(h)
        return pa.Table.from_pydict({"shard": [key[0].as_py()], "path": [write_level(folder, {"hash": h[by], "value": v[by]})]})

    rows = grams.select("lang", "gram", F.ln("q").cast("float").alias("v")).mapInArrow(keyed, "key long, v float")
    rows = rows.withColumn("s", F.shiftrightunsigned("key", 1) % n).groupBy("s").applyInArrow(write, "shard long, path string")
    paths = {r.shard: r.path for r in rows.collect()}
    return Estimates([paths.get(s) for s in range(n)])


def score_quality(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, width: float = 3.0, slack: float = 0.1) -> DataFrame:
    """Counts, base verdict, perplexity, bands and verdict of every document.

    Rows that repeat an id or a whole row are rows of their own and count in the
    model as often as they stand there; null ids are like any other; an empty
    table gives no row; columns besides doc_id, text and lang play no part.
    Null text counts as empty: it has no word, fails the base rules and has
    perplexity null. Documents of null language have a model and band of their
    own. A band is at least ``slack`` wide on either side of its quartiles (in
    ln perplexity), so that equal documents pass. Quartiles are taken over all
    documents that pass the base rules, to three decimals.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"))
    model = spark.sparkContext.broadcast(fit_perplexity(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimates: Estimates = model.value
        for batch in pieces(batches, mb=4):
            whole = texts(batch.column(1))
            total = np.zeros(len(whole))
            for lang, own, group in by_language(batch, 1, 2):
                flat, at, sizes = gram_places(group)
                known = estimates.of(gram_hashes([flat[at + k] for k in range(ORDER)], seed(lang)))
                sums = np.concatenate([[0.0], np.cumsum(known, dtype=float)])
                ends = np.cumsum(sizes)
                total[own] = sums[ends] - sums[ends - sizes]
            facts = np.array([text_facts(x) for x in whole], np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, facts), pa.array(total)], [x.split()[0] for x in FACTS.split(", ")])

    facts = cut(rows.mapInArrow(run, FACTS), "quality-facts")
    facts = facts.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
        "log_ppl": F.when(F.col("n_words") > 0, F.round(-F.col("log_p") / F.col("n_words"), 3)),
    })
    quarter = facts.filter(~F.col("base_failed")).groupBy("lang").agg(F.percentile("log_ppl", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    reach = F.greatest(width * (F.col("q")[1] - F.col("q")[0]), F.lit(slack))
    bands = quarter.select("lang", (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))
    out = facts.join(F.broadcast(bands), "lang", "left")  # one row for each language
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with the production rules."""
    return score_quality(table(spark, sf_dir, "documents"))
