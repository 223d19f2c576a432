"""N-gram Jaccard join by a MinHash LSH forest.

Each text is a set of shingles of five words. Its label in each tree of the forest
is a sequence of ``DEEPEST`` minhashes; a tree is the trie of all labels, and a
node of it is a common prefix. The length of the prefix that must match follows from
the threshold and the wanted recall alone (``likely_depth``): no part of the rows is
measured for it. ``measured_depth`` tells what prefix the links of query documents
(those whose id is divisible by 50) would allow; a caller may pass it as ``depth``.
Documents below one node of that depth are candidates, verified exactly on the sets of
their shingles, each told by 64 bits of its words' xxh3.

Documents with the same words are one class, represented by the smallest id, so
copies cost one member. A node with many members, or many shingles, is cut into
tiles of bounded size, and each pair of tiles is one unit of work that returns sums
for each member, never pairs; so one near-copy group may hold a third of all rows
and still be dealt over all tasks. A pair is taken at the first tree where it meets
and in one tile pair, hence counted once. Links are also joined to components.

Defined results: a text of one to four words is one shingle. Null texts, and those
without words, are alone: class their own id, no links; so are rows without an id.
A very long text is one set of its shingles, held by one task at a time with those
of its tile. Each row of the input gives a row; ``n_links`` counts the other rows at
the threshold or above, copies included. Rows that repeat an id are judged each by
its own text, classes of one id being told apart by 64 bits of a digest. An empty table gives no rows. Other columns are not read, whatever
their names (``one_of_each`` returns them unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, Words, free_name, materialize
from marlstone.llm.components import components

TREES, DEEPEST, SHALLOWEST = 16, 8, 3
TILE, TILE_SHINGLES = 512, 1 << 19
SHINGLE = 5
QUERIES = 50  # ids divisible by this are the queries that recall is measured on
LEAST_LINKS = 100  # fewer measured links do not tell a recall
SIGNED = "doc_id long, text_hash long, k1 long, k2 long, n_shingles long, labels array<binary>"
CLASS = ("rep", "k1")
NODE = ("tree", "prefix", "ti", "tj")


def likely_depth(threshold: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix length that finds a pair at the threshold with the wanted probability."""
    return next((d for d in range(deepest, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


class Shingles:
    def __init__(self) -> None:
        self.words, self.rolling = Words(), Rolling(0x9E3779B97F4A7C15)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Distinct shingle hashes of each text, sorted."""
        words, sizes = self.words.of_texts(texts)
        ends = np.cumsum(sizes)
        return [np.unique(self.rolling(words[e - n : e], min(SHINGLE, n))) if n else words[:0] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def word_digest(text: bytes) -> tuple[int, int]:
    k1, k2 = np.frombuffer(hashlib.md5(b" ".join(text.split())).digest(), "<i8").tolist()
    return k1, k2


def sign(docs: DataFrame, trees: int = TREES, depth: int = DEEPEST) -> DataFrame:
    """(doc_id, text) with a hash of the text, a digest of the words, number of shingles, and the whole label in each tree, most significant minhash first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        rng = np.random.default_rng(20)
        a, b = rng.integers(0, 1 << 63, (2, trees * depth)).astype(np.uint64)
        a |= np.uint64(1)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts, rows = batch.column(2).cast(pa.binary()).to_pylist(), []
                for text, x in zip(texts, shingles(texts), strict=True):
                    low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
                    for i in range(0, len(x), 1024):
                        part = x[i : i + 1024, None] * a
                        part += b
                        part >>= np.uint64(32)
                        np.minimum(low, part.min(axis=0).astype(np.uint32), out=low)
                    data = low.astype(">u4").tobytes()
                    rows.append((*word_digest(text or b""), len(x), [data[i : i + 4 * depth] for i in range(0, len(data), 4 * depth)] if len(x) else None))
                k1, k2, n, labels = zip(*rows, strict=True) if rows else ((), (), (), ())
                arrays = [batch.column(0), batch.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(labels, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "k1", "k2", "n_shingles", "labels"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNED)


def nodes(classes: DataFrame, depth: int, *columns: str | Column) -> DataFrame:
    """The node of each class in each tree at ``depth``: the prefix of its label, hashed to keep rows short."""
    return classes.select(*CLASS, *columns, F.posexplode("labels").alias("tree", "label")).withColumn("prefix", F.xxhash64(F.substring("label", 1, 4 * depth))).drop("label")


def measured_depth(classes: DataFrame, rows: DataFrame, threshold: float, recall: float) -> int:
    """The longest prefix that keeps ``recall`` of the links of query documents.

    A query meets one partner a tree: the least other member of its shallow
    node. Those pairs are verified exactly, and a link's depth is its longest
    common prefix over all trees.
    """
    shallow = nodes(classes, SHALLOWEST)
    key = F.struct(*CLASS)
    two = shallow.groupBy("tree", "prefix").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high")
    queries = shallow.where(F.col("rep") % QUERIES == 0).withColumn("q", key).join(two, ["tree", "prefix"])
    pairs = queries.select("q", F.when(F.col("low") == F.col("q"), F.col("high")).otherwise(F.col("low")).alias("x")).distinct()
    signed = classes.select(key.alias("c"), "labels")
    texts = rows.select("doc_id", "text")
    side = lambda df, c: df.join(signed.select(F.col("c").alias(c), F.col("labels").alias(f"{c}_labels")), c).join(texts.select(F.col("doc_id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text")), F.col(f"{c}.rep") == F.col(f"{c}_id")).drop(f"{c}_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                a, b = (r[f"{c}_text"].encode() for c in "qx")
                if any(word_digest(t)[0] != r[c]["k1"] for t, c in ((a, "q"), (b, "x"))):
                    continue  # another text under the same id
                x, y = shingles([a, b])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    labels = (np.array([np.frombuffer(v, ">u4") for v in r[f"{c}_labels"]]) for c in "qx")
                    found.append(int(np.logical_and.accumulate(np.equal(*labels), axis=1).sum(axis=1).max()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["depth"])

    counted = materialize(side(side(pairs, "q"), "x").mapInArrow(compare, "depth int").groupBy("depth").count(), "link-depths")
    links = {r["depth"]: r["count"] for r in counted.collect()}  # at most DEEPEST + 1 rows
    if sum(links.values()) < LEAST_LINKS:
        return likely_depth(threshold, recall)
    reached = lambda d: sum(n for deep, n in links.items() if deep >= d) / sum(links.values())
    return next((d for d in range(DEEPEST, SHALLOWEST, -1) if reached(d) >= recall), SHALLOWEST)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each tile pair; a partition is sorted by them."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, group in groupby(rows, key=lambda r: tuple(r[c] for c in NODE)):
        found = {tuple(r[c] for c in CLASS): r for r in group}
        if len(found) > 1:
            yield list(found.values())


def _new_pairs(group: list[dict], depth: int) -> np.ndarray:
    """Which ordered pairs of members belong to this tile pair and meet in no earlier tree."""
    tree, cross = group[0]["tree"], group[0]["ti"] != group[0]["tj"]
    own = np.array([r["own"] for r in group])
    new = own[:, None] != own[None, :] if cross else ~np.eye(len(group), dtype=bool)
    for t in range(tree):
        _, node = np.unique(np.array([r["labels"][t][: 4 * depth] for r in group], dtype=f"V{4 * depth}"), return_inverse=True)
        new &= node[:, None] != node[None, :]
    return new


def _needed(depth: int):
    """Members that have a new pair in their tile pair."""
    names = [*NODE, "own", *CLASS]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            keep = _new_pairs(group, depth).any(axis=1)
            out += [tuple(r[c] for c in names) for r, k in zip(group, keep.tolist(), strict=True) if k]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from a product over the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        total += part @ part.T
    return total


def _verifier(threshold: float, depth: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        key = pa.struct([(c, pa.int64()) for c in CLASS])
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (key, pa.int64(), key), strict=True)], ["node", "links", "root"])

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # an id may come with several texts: only that of the class counts
                digests = [word_digest((t or "").encode())[0] for t in b.column("text").to_pylist()]
                right = [d == k1 for d, k1 in zip(digests, b.column("k1").to_pylist(), strict=True)]
                yield b.filter(pa.array(right, pa.bool_()))

        for group in _groups(texts(batches)):
            sets = shingles([r["text"].encode() for r in group])
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets).astype(np.int64)
            linked = _new_pairs(group, depth) & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9) & (both > 0)
            links = linked @ np.array([r["copies"] for r in group])
            root = list(range(len(group)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in np.flatnonzero(links).tolist():
                for j in np.flatnonzero(linked[i, :i]).tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            name = [{c: r[c] for c in CLASS} for r in group]
            out += [(name[i], int(links[i]), name[find(i)]) for i in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return verify


def grouped(docs: DataFrame, threshold: float, recall: float, tile: int, depth: int | None, id_col: str, text_col: str) -> DataFrame:
    """Each row with its class (rep, copies), its number of links and the leading class of its component; nulls where it has no words or no id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(sign(rows), "signed")
    worded = F.expr("n_shingles > 0 and doc_id is not null")
    classes = signed.where(worded).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    classes = materialize(classes, "classes")
    depth = depth or likely_depth(threshold, recall)
    members = nodes(classes, depth, "n_shingles")
    sizes = members.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    tiles = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("weight") / TILE_SHINGLES))).cast("int")
    members = members.join(sizes, ["tree", "prefix"]).withColumn("tiles", tiles)
    members = members.withColumn("own", F.expr("cast(pmod(xxhash64(rep, k1), tiles) as int)")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    members = members.select("tree", "prefix", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", *CLASS)
    keyed = members.join(classes.select(*CLASS, "labels"), list(CLASS))
    needed = keyed.repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(_needed(depth), "tree int, prefix long, ti int, tj int, own int, rep long, k1 long")
    needed = materialize(needed, "tile-members")
    full = needed.join(classes.select(*CLASS, "copies", "labels"), list(CLASS)).join(rows.select(F.col("doc_id").alias("rep"), "text"), "rep")
    node = "struct<rep:long,k1:long>"
    verified = full.repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(_verifier(threshold, depth), f"node {node}, links long, root {node}")
    verified = materialize(verified, "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    leaders = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("label").alias("leader"))
    found = links.join(leaders, "node", "left").select("node.*", "links", "leader")
    known = classes.select(*CLASS, "k2", "copies").join(found, list(CLASS), "left").withColumn("leader", F.coalesce("leader", F.struct(*CLASS)))
    mine = signed.where(worded).select("doc_id", "text_hash", "k1", "k2").join(known, ["k1", "k2"]).drop("k2")
    return mine.unionByName(signed.where(~F.coalesce(worded, F.lit(False))).select("doc_id", "text_hash", "k1"), allowMissingColumns=True)


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, tile: int = TILE, depth: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links) of each row.

    ``class_id``: least id of the component of links; ``copy_of``: least id with
    the same words; ``n_copies``: rows with the same words, this one included.
    ``depth`` sets the matched prefix instead of ``likely_depth``.
    """
    found = grouped(docs, threshold, recall, tile, depth, id_col, text_col)
    copies = F.coalesce("copies", F.lit(1))
    return found.select(
        "doc_id",
        F.coalesce("leader.rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_of"),
        copies.cast("long").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + copies - 1).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` from each near-duplicate group, with all its columns.

    It is the row with the least id and, where that id has several texts in the
    group, the least text hash; of rows that repeat both, the first by a hash of
    all columns. Texts of other groups under the same id stay. Rows without an
    id or without words stay, each of them.
    """
    found = grouped(docs, threshold, recall, TILE, None, id_col, text_col).where("leader = struct(doc_id, k1)")
    i, h, n = (free_name(docs.columns, c) for c in ("id_", "hash_", "nth_"))
    first = found.groupBy("leader").agg(F.min("text_hash").alias(h)).select(F.col("leader.rep").alias(i), h)
    worded = F.coalesce(F.col(text_col).rlike(r"[^ \t-\r]") & F.col(id_col).isNotNull(), F.lit(False))
    keyed = docs.where(worded).withColumns({i: F.col(id_col).cast("long"), h: F.xxhash64(F.col(text_col).cast("string"))})
    same = Window.partitionBy(i, h).orderBy(F.xxhash64(*docs.columns))
    kept = keyed.join(first, [i, h], "left_semi").withColumn(n, F.row_number().over(same)).where(F.col(n) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
