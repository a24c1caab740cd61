"""Token counts of texts by a two-tier lookup of pre-tokens on the map side.

A pre-token is a run of spaces with the non-spaces behind it. No piece of the
vocabulary holds a space after anything else, so merges never cross pre-tokens
and a text's tokens are the sum over its pre-tokens (checked when the model is
loaded). Tier one is a compact hash table of the corpus's frequent pre-tokens
(their texts in one block, their lengths in two bytes each), of bounded size,
sent to every worker. What it lacks goes
to tier two: the worker's own cache, filled by encoding the missing pre-tokens.
Texts' pre-tokens are never shuffled to be counted; the only rows that move are
each task's heaviest ones, a bounded number, from which tier one is made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import held, pieces, texts
from tessera.sources.tables import table

#: Pre-tokens that each task reports, and those that tier one holds.
PER_TASK, FREQUENT = 4096, 32768
#: Entries of a worker's cache before it starts anew; longer pre-tokens are not cached.
CACHE, CACHED_CHARS = 400_000, 64
#: A task drops its rarest counts when it holds so many.
COUNTED = 300_000

_RUN = re.compile(" *[^ ]+| +")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space (the model puts it back); a lone space is ``""``."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUN.findall(" " + text)]


class PieceCounter:
    """Counts tokens with a piece model: ``frequent`` (tier one) and a cache of what it lacks (tier two)."""

    def __init__(self, path: str, words: bytes = b"", lengths: bytes = b""):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for i in range(self.model.get_piece_size()) if "▁" in (p := self.model.id_to_piece(i)).lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces hold spaces inside, so pre-tokens do not stand alone: {crossing[:3]}")
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.frequent = dict(zip(words.decode().split(" "), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if lengths else {}
        self.known = dict(self.frequent)

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x) if w else self.space for w, x in zip(words, self.model.encode(words, num_threads=1), strict=True)]

    def count(self, batch: list[list[str]]) -> list[int]:
        """Tokens of each text, given as its pre-tokens."""
        known = self.known
        missing = list(set().union(*batch).difference(known))
        if len(known) + len(missing) > CACHE + len(self.frequent):
            known = self.known = dict(self.frequent)
            missing = list(set().union(*batch).difference(known))
        for i in range(0, len(missing), 20_000):
            known.update(zip(missing[i : i + 20_000], self.lengths(missing[i : i + 20_000]), strict=True))
        out = [sum(map(known.__getitem__, words)) for words in batch]
        for w in missing:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out


def frequent_pretokens(docs: DataFrame, k: int = FREQUENT) -> list[str]:
    """The ``k`` pre-tokens with most occurrences as far as tasks' heaviest ones show: a cache's content, no statistic."""

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in pieces(batches):
            for text in texts(batch.column(0)):
                seen.update(pretokens(text))
            if len(seen) > COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED // 3)))
        top = [(w, n) for w, n in seen.most_common(PER_TASK) if w and " " not in w and len(w) <= CACHED_CHARS]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    heads = docs.select("text").mapInArrow(heaviest, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in heads.orderBy(F.desc("n"), "word").limit(k).collect()]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text under the piece model at ``model``.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows
    give a row each. Whole texts are counted, whatever their length. No begin or
    end token is added, and special strings inside a text are ordinary text.
    """
    spark = docs.sparkSession
    words = frequent_pretokens(docs)
    tier = spark.sparkContext.broadcast(
        (" ".join(words).encode(), np.array(PieceCounter(model).lengths(words), np.uint16).tobytes()) if words else (b"", b"")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in pieces(batches, mb=4, owner="token_count"):
            counter = counter or _counter(model, tier)
            whole = texts(batch.column(1))
            tokens = []
            for i in range(0, len(whole), 64):
                tokens += counter.count([pretokens(x) for x in whole[i : i + 64]])
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def _counter(model: str, tier) -> PieceCounter:
    """The worker's counter for this model and tier; a worker serves many tasks."""
    key = f"{model}\n{tier.id if hasattr(tier, 'id') else id(tier)}"
    own = held.setdefault("token_count", {})
    if key not in own:
        own.clear()
        own[key] = PieceCounter(model, *tier.value)
    return own[key]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` under the piece vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
