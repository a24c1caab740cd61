"""Join of documents whose word n-gram sets are similar, through a token-group matrix.

Equal sets first become one class, named by its smallest document id. Tokens
(64-bit hashes of n-grams) have one order for all documents: rare before
frequent, then by hash. Two sets with Jaccard similarity of at least t share a
token among the first ``n - ceil(t n) + 1`` of each, so only these are posted.

1. Grouping. Under the first few of its posted tokens that others post too, each
   class is linked to the next one in an order that differs from token to token;
   the verified links make groups of similar documents, as few links a class
   rather than all pairs.
2. Matrix. The posted tokens of a group's members are united: one row per token
   and group, with the smallest size and the largest rest (tokens from that
   position on) of its members. Hot tokens of a large group are one row.
3. Bound. Groups that share a token can only be linked if the smaller rest covers
   the overlap that the smaller sizes need; then per-bucket counts of tokens
   bound the overlap of a query and a group.
4. Opening. Only the groups that pass are opened: a few pairs of their members
   are tried first, and groups that this has not brought together are opened in
   full. Members are bounded one by one in the same way and verified with whole
   sets.

Nothing is capped: a token in many groups or a group with many members costs
more pairs of bounds, never a lost link.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.mapped import SortedSets, map_level, repeated_numbers, write_level
from tessera.llm.text import pieces
from tessera.llm.words import utf8, word_hashes
from tessera.sources.shared import cut, fresh_path, release
from tessera.sources.tables import table

#: Frequent tokens that are sent to the workers at most (8 bytes each); the threshold rises until they fit.
MAX_FREQUENT = 2_000_000
#: A task reports tokens that so many of its own documents have.
LOCAL = 4
#: Shared tokens under which a class is linked for grouping, and buckets of the bound.
LINKS, BUCKETS = 4, 128
#: Pairs of members that are tried before a pair of groups is opened in full.
PROBES = 8
#: Members of a group that meet those of another at once.
BLOCK = 256
#: The largest count of a bucket; sets that reach it are not bounded but verified.
MANY = 65_535
#: Bytes of posted tokens for each range of tokens; files of sets that a task keeps open.
POSTED, FILES = 16 << 20, 500
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    words, counts = word_hashes(*utf8(column))
    h = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * _MIX[k % 4]
        h ^= h >> np.uint64(29)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= n:
            x = np.sort(h[a : b - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:  # the whole sequence
            x = np.uint64(b - a)
            for k, w in enumerate(words[a:b]):
                x = (x ^ w) * _MIX[k % 4]
                x ^= x >> np.uint64(29)
            yield np.array([x] if b > a else [], np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that several documents of a task share, the most frequent first while they fit; sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        total = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def fold() -> tuple[np.ndarray, np.ndarray]:
            x, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            x, c = np.concatenate([total[0], x]), np.concatenate([total[1], c])
            order = np.argsort(x, kind="stable")
            x, c = x[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            return x[first], np.add.reduceat(c, first) if len(first) else c

        for batch in pieces(batches, mb=4):
            for s in shingle_sets(batch.column(0), n):
                held.append(s)
                room += len(s)
            if room > 1_500_000:
                total, held, room = fold(), [], 0
                total = (total[0][total[1] > 1], total[1][total[1] > 1])  # only the order of tokens depends on these counts
        x, c = fold()
        x, c = x[c >= LOCAL], c[c >= LOCAL]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c)], ["token", "n"])

    sums = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    sums = cut(sums, "jaccard-frequent")
    least, count = LOCAL, sums.count()
    while count > MAX_FREQUENT:
        least *= 2
        count = sums.filter(F.col("n") >= least).count()
    found = sums.filter(F.col("n") >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.view(np.uint64))


def in_sorted(x: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return table_[at] == x


def documents_with_prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig (of the set), prefix (posted tokens in order) of every row."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, mb=4):
            size, sig, prefix = [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                often = in_sorted(s, common.value)
                prefix.append(np.concatenate([s[~often], s[often]])[: prefix_length(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig), pa.array(prefix)], ["doc_id", "n_shingles", "sig", "prefix"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_shingles long, sig binary, prefix binary")


def postings(classes: DataFrame) -> DataFrame:
    """(token, node, n, rest, place): the posted tokens of classes that two or more classes post (and a few others)."""
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    rows = classes.select("node", "n_shingles", "prefix")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)

    shared = spark.sparkContext.broadcast(repeated_numbers(rows, tokens_of, 1 + total // POSTED, fresh_path(spark, "jaccard-tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            token = np.frombuffer(b"".join(packed), np.uint64)
            size = np.array([len(x) // 8 for x in packed])
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            node, n = (np.repeat(batch.column(k).to_numpy(), size) for k in (0, 1))
            own = np.flatnonzero(shared.value.contains(token))
            out = [token[own].view(np.int64), node[own], n[own].astype(np.int32), (n - place)[own].astype(np.int32), place[own].astype(np.int32)]
            for a in range(0, len(own), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in out], ["token", "node", "n", "rest", "place"])

    return rows.mapInArrow(run, "token long, node long, n int, rest int, place int")


def needed(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of these sizes need at least."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def fits(n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def whole_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, file, at, size, bins): where the whole sets of the documents ``nodes`` lie in the shared folder, and their counts per bucket."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "jaccard-sets")
    wanted = spark.sparkContext.broadcast(SortedSets.write(nodes.select(F.xxhash64("node").alias("key")), folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows: list[list] = [[], [], []]

        def written() -> pa.RecordBatch:
            file = int.from_bytes(os.urandom(7), "little")
            size = np.array([len(x) for x in held], np.int64)
            write_level(f"{folder}/sets", {"tokens": np.concatenate(held)}, name=str(file))
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(np.full(len(size), file)), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(rows[1], pa.binary())], ["node", "file", "at", "size", "bins"])
            held.clear()
            for x in rows:
                x.clear()
            return out

        for batch in pieces(batches, mb=4):
            batch = batch.filter(pa.array(wanted.value.contains(batch.column(2).to_numpy().view(np.uint64))))
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                held.append(s)
                rows[0].append(node)
                rows[1].append(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BUCKETS).clip(max=MANY).astype(np.uint16).tobytes())
            if sum(map(len, held)) > 2_000_000:
                yield written()
        if held:
            yield written()

    rows = _rows(docs.filter("doc_id is not null"))
    sets = cut(rows.withColumn("key", F.xxhash64("doc_id")).mapInArrow(run, "node long, file long, at long, size long, bins binary"), "jaccard-sets")
    return sets.withColumn("folder", F.lit(f"{folder}/sets"))


def bucket_counts(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint16).reshape(-1, BUCKETS).astype(np.int64)


def may_be_similar(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether bucket counts, row by row, leave room for the overlap that similarity needs."""
    both = np.minimum(x, y).sum(-1)
    return ((100 + percent) * both >= percent * (x.sum(-1) + y.sum(-1))) | (np.maximum(x, y) == MANY).any(-1)


def similar(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; only where these lie is sent."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[tuple[str, int], np.ndarray] = {}

        def tokens(folder: str, file: int, at: int, size: int) -> np.ndarray:
            if (folder, file) not in files:
                if len(files) >= FILES:
                    files.clear()
                files[folder, file] = map_level(f"{folder}/{file}")["tokens"]
            return files[folder, file][at : at + size]

        for batch in batches:
            folder, *where = (c.to_pylist() for c in batch.columns[2:])
            keep = []
            for r, f in enumerate(folder):
                small, large = sorted((tokens(f, *(c[r] for c in where[:3])), tokens(f, *(c[r] for c in where[3:]))), key=len)
                both = int(in_sorted(small, large).sum()) if 100 * len(small) >= percent * len(large) else 0
                keep.append(100 * both >= percent * (len(small) + len(large) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("node").alias("a"), F.col("file").alias("f"), F.col("at").alias("i"), F.col("size").alias("n"), "folder")
    right = sets.select(F.col("node").alias("b"), F.col("file").alias("g"), F.col("at").alias("j"), F.col("size").alias("m"))
    rows = near.join(left, "a").join(right, "b").select("a", "b", "folder", "f", "i", "n", "g", "j", "m")
    return rows.mapInArrow(exact, "a long, b long").distinct()


def grouping_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of neighbours under a class's first shared tokens, in orders that differ from token to token.

    The order is cut into ranges, so a token that very many classes post is dealt
    over several tasks; the chain is open where ranges meet.
    """
    nth = F.row_number().over(Window.partitionBy("node").orderBy("place", "token"))
    rows = posted.withColumn("nth", nth).filter(F.col("nth") <= LINKS).select("token", "node", "n", F.xxhash64("node", "token").alias("order"))
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["token", "order", "node"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64)] * 3
        for batch in batches:
            token, node, n = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(last))
            last = [x[-1:] for x in (token, node, n)]
            small, large = np.minimum(n[1:], n[:-1]), np.maximum(n[1:], n[:-1])
            met = np.flatnonzero((token[1:] == token[:-1]) & (node[1:] != node[:-1]) & (100 * small >= percent * large))
            a, b = np.minimum(node[met], node[met + 1]), np.maximum(node[met], node[met + 1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("token", "node", F.col("n").cast("long"))
    return ordered.mapInArrow(chain, "a long, b long").distinct()


def group_pairs(posted: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of groups that a row of the token-group matrix holds both and whose bound allows a link."""
    matrix = posted.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    matrix = matrix.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    matrix = cut(matrix, "jaccard-matrix")
    shared = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    contested = matrix.join(shared, "token")
    other = contested.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "low", "high", "rest")])
    both = contested.join(other, "token").filter("g < g2")
    # sizes that some member of one and some member of the other may have
    sizes = (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
    enough = F.least("rest", "rest2") >= needed(F.col("low"), F.col("low2"), percent)
    return both.filter(sizes & enough).select("g", F.col("g2").alias("h")).distinct()


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets are those of distinct word n-grams after A-Z become small letters; a
    text of fewer words is one shingle. Null and empty texts have no shingle and
    are linked with nothing. A row without id has component null and takes no
    part. Rows with one id are one document with the links of all of them.
    """
    spark = docs.sparkSession
    facts = cut(documents_with_prefixes(docs, n, percent), "jaccard-docs")
    live = facts.filter("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("sig").agg(F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("x"))
    classes = cut(classes.select("sig", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.prefix"), "jaccard-classes")
    posted = cut(postings(classes), "jaccard-postings")

    release(spark)

    sets = whole_sets(docs, posted.select("node").distinct(), n)
    links = cut(similar(grouping_pairs(posted, percent), sets, percent), "jaccard-links")
    # ids that stand in several classes tie these together
    ties = live.select("doc_id", "sig").join(classes.select("sig", "node"), "sig").filter("doc_id != node")
    twice = ties.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    heads = classes.select(F.col("node").alias("a"))
    twice = twice.join(heads, "a", "left_semi").unionByName(twice.groupBy("a").agg(F.min("b").alias("b0"), F.max("b").alias("b")).filter("b0 != b").select(F.col("b0").alias("a"), "b"))
    groups = cut(components(links.unionByName(twice)), "jaccard-groups")

    opened = cut(group_pairs(posted, groups, percent), "jaccard-opened")
    sized = classes.select("node", F.col("n_shingles").alias("n")).join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    sized = cut(sized.select("node", "n", "g"), "jaccard-members")
    release(spark, posted)
    links = links.unionByName(cut(similar(probed_pairs(opened, sized, percent), sets, percent), "jaccard-links"))
    groups = cut(components(links.unionByName(twice)), "jaccard-groups")

    apart = cut(still_apart(opened, groups.select(F.col("node").alias("g"), "component"), sized), "jaccard-apart")
    links = links.unionByName(cut(similar(open_groups(apart, sized, sets, percent), sets, percent), "jaccard-links"))
    release(spark)
    groups = components(links.unionByName(twice))
    final = groups

    named = classes.select("sig", "node").join(final, "node", "left").select("sig", F.coalesce("component", "node").alias("c"))
    out = facts.join(named, "sig", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(a, b), a < b: all similar pairs of classes, each named by the least id that has its set.

    Every class is a group of its own here, so each pair that the bound allows is
    opened. Rows are told apart by id and text, as an id may have several sets.
    """
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    rows = rows.withColumn("doc_id", F.xxhash64("id", "text"))
    facts = cut(documents_with_prefixes(rows.select("doc_id", "text"), n, percent), "jaccard-docs").filter("n_shingles > 0")
    classes = facts.groupBy("sig").agg(F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("x"))
    classes = cut(classes.select("sig", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.prefix"), "jaccard-classes")
    alone = docs.sparkSession.createDataFrame([], "node long, component long")
    posted = cut(postings(classes), "jaccard-postings")
    pairs = group_pairs(posted, alone, percent).toDF("a", "b")
    sets = whole_sets(rows.select("doc_id", "text"), posted.select("node").distinct(), n).dropDuplicates(["node"])
    links = similar(pairs, sets, percent)
    named = facts.select("doc_id", "sig").distinct().join(rows.select("doc_id", "id"), "doc_id").groupBy("sig").agg(F.min("id").alias("id"))
    named = cut(named.join(classes.select("sig", "node"), "sig").select("node", "id"), "jaccard-names")
    links = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").filter("x != y")
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def probed_pairs(opened: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of each pair of groups: all if there are up to PROBES, else so many by hash; most that belong together meet here."""
    place = Window.partitionBy("g").orderBy(F.xxhash64("node"), "node")
    members = sized.withColumns({"i": F.row_number().over(place) - 1, "k": F.count(F.lit(1)).over(Window.partitionBy("g"))})
    members = cut(members, "jaccard-places")
    counts = members.filter("i = 0").select("g", "k")
    rows = opened.join(counts, "g").join(counts.select(F.col("g").alias("h"), F.col("k").alias("k2")), "h")
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.least(F.lit(PROBES), F.col("k") * F.col("k2")).cast("int"))))
    few = F.col("k") * F.col("k2") <= PROBES
    i = F.when(few, F.pmod(F.col("t") - 1, F.col("k"))).otherwise(F.pmod(F.xxhash64("g", "h", "t"), F.col("k")))
    i2 = F.when(few, F.floor((F.col("t") - 1) / F.col("k"))).otherwise(F.pmod(F.xxhash64("t", "h", "g"), F.col("k2")))
    rows = rows.select("g", "h", i.alias("i"), i2.alias("i2"))
    mine = members.select("g", "i", F.col("node").alias("a"), "n")
    theirs = members.select(F.col("g").alias("h"), F.col("i").alias("i2"), F.col("node").alias("b"), F.col("n").alias("m"))
    pairs = rows.join(mine, ["g", "i"]).join(theirs, ["h", "i2"]).filter(fits(F.col("n"), F.col("m"), percent))
    return cut(pairs.select("a", "b").distinct(), "jaccard-probes")


def still_apart(opened: DataFrame, merged: DataFrame, sized: DataFrame) -> DataFrame:
    """The pairs of groups that are in different components and have more pairs of members than were tried."""
    counts = sized.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    many = F.coalesce("k", F.lit(1)) * F.coalesce("k2", F.lit(1)) > PROBES
    opened = opened.join(counts, "g", "left").join(counts.select(F.col("g").alias("h"), F.col("k").alias("k2")), "h", "left").filter(many)
    other = merged.select(F.col("g").alias("h"), F.col("component").alias("component2"))
    named = opened.join(merged, "g", "left").join(other, "h", "left")
    return named.filter(F.coalesce("component", "g") != F.coalesce("component2", "h")).select("g", "h")


def open_groups(opened: DataFrame, sized: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of opened groups that bucket counts leave possible; members meet in blocks of BLOCK."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("node")) - 1
    members = sized.select("g", "node").join(sets.select("node", "bins"), "node").withColumn("block", F.floor(place / BLOCK))
    blocks = members.groupBy("g", "block").agg(F.collect_list("node").alias("nodes"), F.collect_list("bins").alias("bins"))
    blocks = cut(blocks.select("g", "nodes", "bins"), "jaccard-blocks")
    theirs = blocks.select(F.col("g").alias("h"), F.col("nodes").alias("nodes2"), F.col("bins").alias("bins2"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bins, nodes2, bins2 = batch.columns
            for r in range(batch.num_rows):
                a, b = nodes[r].values.to_numpy(), nodes2[r].values.to_numpy()
                x, y = bucket_counts(bins[r].as_py()), bucket_counts(bins2[r].as_py())
                hits = [np.flatnonzero(may_be_similar(row[None], y, percent)) for row in x]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, [len(h) for h in hits])), pa.array(b[np.concatenate(hits)])], ["a", "b"])

    rows = opened.join(blocks, "g").join(theirs, "h").select("nodes", "bins", "nodes2", "bins2")
    return cut(rows.mapInArrow(bound, "a long, b long").distinct(), "jaccard-near")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: 4-word shingles, similarity 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS t FROM w),
c AS (SELECT min(doc_id) AS node, any_value(t) AS t, len(any_value(t)) AS n FROM s WHERE len(t) > 0 GROUP BY list_sort(t)),
x AS (
  SELECT node, n, unnest(list_sort([md5(v) FOR v IN t])[1 : n - (85 * n + 99) // 100 + 1]) AS v FROM c),
p AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM x a JOIN x b ON a.v = b.v AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
e AS (
  SELECT a, b FROM (SELECT a, b, l.n + r.n AS total, len(list_intersect(l.t, r.t)) AS k
                    FROM p JOIN c l ON l.node = a JOIN c r ON r.node = b) WHERE 100 * k >= 85 * (total - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, b AS other FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.other = u.a),
least_of AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.t)::BIGINT AS n_shingles,
       coalesce(l.component, c.node, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.t) > 0 AND list_sort(s.t) = list_sort(c.t) LEFT JOIN least_of l ON l.node = c.node
"""
