"""Language identification by nearest centroid.

A text is normalised (letters in lower case, everything else one space) and its
1- to 3-letter n-grams, hashed into a fixed number of features, make a TF-IDF
vector of length one. Each language has several centroids, from spherical
k-means over a bounded sample of labelled texts. The centroid with the largest
cosine names the language; a text whose distance from it is beyond what its
length explains is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import crc_mod, pieces, texts
from tessera.sources.tables import table

FEATURES = 1 << 13
#: Labelled texts of each language that the centroids are fitted on (expected number; all if there are fewer).
SAMPLE = 500
CENTROIDS = 4
#: A text is rejected if its cosine is below this share of what its centroid's texts of like length reach.
REJECT = 0.2
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """The small letter of each letter's code point, a space for any other."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a whole text, and its number of letters."""
    flat = letters()[np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)]
    blank = flat == 32
    n = len(flat) - int(blank.sum())
    flat = flat[~(blank & np.concatenate([[False], blank[:-1]]))]
    one = flat * np.uint32(2654435761)
    two = flat[:-1] * np.uint32(2246822519) + flat[1:] * np.uint32(3266489917)
    three = two[:-1] * np.uint32(668265263) + flat[2:] * np.uint32(374761393)
    out = np.zeros(FEATURES, np.int64)
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(15))
        out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=FEATURES)
    return out, n


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    w = np.log1p(counts, dtype=np.float32) * idf
    return w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-12)


class Centroids:
    """idf, centroids (rows of length one), their languages, and the cosine that 300 letters reach."""

    def __init__(self, idf: np.ndarray, rows: np.ndarray, names: list[str], usual: np.ndarray):
        self.idf, self.rows, self.names, self.usual = idf, rows, names, usual

    @staticmethod
    def fit(labels: list[str], counts: np.ndarray, sizes: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> "Centroids":
        idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = weigh(counts, idf)
        label = np.array(labels, object)
        rows, names, usual = [], [], []
        for name in sorted(set(labels)):
            own, n = x[label == name], sizes[label == name]
            # the start: texts in turn farthest from those chosen, the first nearest to the mean
            at = [int(np.argmax(own @ own.mean(0)))]
            near = own @ own[at[0]]
            while len(at) < min(k, len(own)):
                at.append(int(np.argmin(near)))
                near = np.maximum(near, own @ own[at[-1]])
            mid = own[at]
            for _ in range(rounds):
                which = np.argmax(own @ mid.T, 1)
                mid = np.stack([own[which == j].sum(0) if (which == j).any() else mid[j] for j in range(len(mid))])
                mid = mid / np.maximum(np.sqrt((mid * mid).sum(1, keepdims=True)), 1e-12)
            cos = own @ mid.T
            which = np.argmax(cos, 1)
            for j in range(len(mid)):
                scaled = (cos[which == j, j] / shrink(n[which == j])) if (which == j).any() else np.ones(1)
                rows.append(mid[j])
                names.append(name)
                usual.append(float(np.median(scaled)))
        return Centroids(idf, np.stack(rows).astype(np.float32), names, np.array(usual))

    def nearest(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each row; the first centroid wins ties."""
        cos = weigh(counts, self.idf) @ self.rows.T
        best = np.argmax(cos, 1)
        top = np.clip(cos[np.arange(len(cos)), best].astype(float), 0, 1)
        return [self.names[i] for i in best], top, top < REJECT * self.usual[best] * shrink(sizes)


def shrink(letters_in: np.ndarray) -> np.ndarray:
    """How the cosine falls for short texts, relative to long ones."""
    n = np.asarray(letters_in, float)
    return np.sqrt(n / (n + 300))


def fit_languages(labelled: DataFrame, per_language: int = SAMPLE) -> Centroids | None:
    """Centroids from (doc_id, text, lang); None if no row has a language and a letter.

    About ``per_language`` texts of each language are taken, those whose hashes of
    id and text are small; null and repeated ids make no difference to that. Rows
    that repeat both come or go together. An empty table gives None, and other
    columns play no part.
    """
    known = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    taken = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**53)) < rate[F.col("lang")] * 2**53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, mb=4):
            found = [features(x) for x in texts(batch.column(0))]
            at = [np.flatnonzero(c) for c, _ in found]
            columns = [pa.array([i.astype(np.uint16).tobytes() for i in at]), pa.array([c[i].astype(np.uint32).tobytes() for i, (c, _) in zip(at, found, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns, pa.array([n for _, n in found], pa.int64())], ["lang", "at", "n", "letters"])

    got = [r for r in taken.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary, letters long").collect() if r.letters]
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))  # the same fit in whatever order tasks end
    x = np.zeros((len(got), FEATURES), np.uint32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.uint32)
    return Centroids.fit([r.lang for r in got], x, np.array([r.letters for r in got]))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    A text that is null or has no letter is ``und`` with score 0 and rejected;
    so is any text if there is no model. All other columns are kept; those named
    like a result are replaced. Whole texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: Centroids | None = sent.value
        for batch in pieces(batches):
            names, scores, out = [], [], []
            whole = texts(batch.column(at))
            for i in range(0, len(whole), 64):
                found = [features(x) for x in whole[i : i + 64]]
                sizes = np.array([n for _, n in found])
                if centroids is None:
                    pred, top, far = [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
                else:
                    pred, top, far = centroids.nearest(np.stack([c for c, _ in found]), sizes)
                names += [p if n else UNKNOWN for p, n in zip(pred, sizes, strict=True)]
                scores.append(np.where(sizes > 0, top, 0.0))
                out.append(far | (sizes == 0))
            more = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*rest, "lang_pred", "score", "rejected"])

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*rest).mapInArrow(run, schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """All ``documents``; learned from those whose crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5)
    model = fit_languages(docs.filter(held != 0).select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), "text")
    return identify(slim, model).drop("text")
