"""Merkle manifest of a dataset: a tree a group, a tree over the groups, a proof a row.

Rows become digests in the JVM, so that no text is shuffled. ``ranked`` gives them
their places: a range partitioning by (group, order), a number within each
partition, and the partitions' sizes, of which the driver adds up one a partition.
From then on a tree is known by its width alone, and so is the arity of every run
of siblings: ``WAYS``, or what is left at the end of a level.

A ``Forest`` is a sparse set of nodes keyed by (tree, level, index) that no complete
run holds yet. Forests form a commutative monoid: their sum is the union of their
nodes, in which each run that is now complete is replaced by its parent, as often as
that goes. A chunk of consecutive leaves leaves at most ``2 * (WAYS - 1)`` open nodes
a level of a tree, and the trees that lie within the chunk are leaves of the tree
over the groups, where the same holds. ``treeReduce`` adds up the chunks' forests to
the root. Nodes that were open somewhere are kept as the spine: so many a level and
chunk, whatever the number of rows or groups. It is sent to all tasks, in which
each chunk is hashed again, read downwards for the siblings of each leaf, and
every leaf, altered or not, is folded up to a root by them.

Defined results: rows of a group stand by their order column, nulls first, and equal
ones by their digest, so that repeated rows are neighbours. A null group is a group of
its own, the first. A group of one row is that row's digest, a dataset of one group that
group's. A row without an id is never altered. Other columns are not read, whatever
their names; a very long text is hashed by one task. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

WAYS = 3
#: Chunks start at multiples of so many leaves of a group, so that within a group all their open nodes stand above.
BLOCK = WAYS**8
#: Leaves of a chunk, which one task holds, to within a block; between these bounds a share of the rows.
FEWEST, MOST = BLOCK, 1 << 20
OVER = -1  #: The tree over the groups.


def joined(parts: list[bytes]) -> bytes:
    """The digest of several digests, all as hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def width_at(width: int, level: int) -> int:
    """Nodes of a level of a tree with so many leaves."""
    for _ in range(level):
        width = -(-width // WAYS)
    return width


class Forest:
    """Nodes keyed by (tree, level, index) without a complete run, as ``open``; all that were open at some time, as ``known``. ``widths`` has the leaves of each tree."""

    def __init__(self, groups: int) -> None:
        self.widths, self.open, self.known = {OVER: groups}, set(), {}

    def put(self, tree: int, level: int, index: int, node: bytes) -> None:
        self.known[tree, level, index] = node
        self.open.add((tree, level, index))

    def __add__(self, other: Forest) -> Forest:
        out = Forest(self.widths[OVER])
        out.widths = self.widths | other.widths
        out.known, out.open = self.known | other.known, self.open | other.open
        return out.settled()

    def settled(self) -> Forest:
        """Every complete run replaced by its parent, every root of a group a leaf of the tree over the groups."""
        todo = list(self.open)
        while todo:
            tree, level, index = key = todo.pop()
            if key not in self.open:
                continue
            width = width_at(self.widths[tree], level)
            if width == 1:
                if tree == OVER:
                    continue
                run, above = [key], (OVER, 0, tree)
                node = self.known[key]
            else:
                first = index - index % WAYS
                run, above = [(tree, level, i) for i in range(first, min(first + WAYS, width))], (tree, level + 1, index // WAYS)
                if not self.open.issuperset(run):
                    continue
                node = joined([self.known[k] for k in run])
            self.open.difference_update(run)
            if above not in self.known:
                self.put(*above, node)
                todo.append(above)
        return self


class Span:
    """Consecutive nodes of a tree's leaves, and level by level those parents whose whole run is among them."""

    def __init__(self, width: int, first: int, leaves: list[bytes]) -> None:
        self.width, self.levels = width, [(first, leaves)]
        while width > 1:
            start, nodes = self.levels[-1]
            skip = -start % WAYS
            end = start + len(nodes)
            full = end if end == width else end - end % WAYS
            above = [joined(nodes[i : min(i + WAYS, full - start)]) for i in range(skip, full - start, WAYS)]
            if not above:
                break
            self.levels.append(((start + skip) // WAYS, above))
            width = -(-width // WAYS)

    def get(self, level: int, index: int) -> bytes | None:
        if level < len(self.levels):
            start, nodes = self.levels[level]
            if 0 <= index - start < len(nodes):
                return nodes[index - start]
        return None

    def root(self) -> bytes | None:
        start, nodes = self.levels[-1]
        return nodes[0] if width_at(self.width, len(self.levels) - 1) == 1 and nodes else None

    def loose(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, index, node) of those that no run here holds."""
        for level, (start, nodes) in enumerate(self.levels):
            taken = range(0)
            if level + 1 < len(self.levels):
                over, parents = self.levels[level + 1]
                taken = range(over * WAYS, (over + len(parents)) * WAYS)
            for i in [*range(start, min(start + len(nodes), taken.start)), *range(max(start, taken.stop), start + len(nodes))] if taken else range(start, start + len(nodes)):
                yield level, i, nodes[i - start]


class Chunk:
    """The spans of one chunk: one a group, and one of the tree over those groups that lie within it."""

    def __init__(self, groups: int, starts: list[tuple[int, int, int, int]], leaves: list[bytes]) -> None:
        """``starts``: (place in ``leaves``, group, width, index) of each group's first leaf here."""
        self.spans: dict[int, Span] = {}
        for (at, group, width, first), end in zip(starts, [*(s[0] for s in starts[1:]), len(leaves)], strict=True):
            self.spans[group] = Span(width, first, leaves[at:end])
        roots = [(g, r) for g, s in self.spans.items() if (r := s.root())]
        self.groups = groups
        self.spans[OVER] = Span(groups, roots[0][0], [r for _, r in roots]) if roots else Span(groups, 0, [])

    def forest(self) -> Forest:
        out = Forest(self.groups)
        for tree, span in self.spans.items():
            if tree != OVER and span.root():
                continue  # stands as a leaf over the groups
            out.widths[tree] = span.width
            for level, index, node in span.loose():
                out.put(tree, level, index, node)
        return out

    def paths(self, spine: dict[tuple[int, int, int], bytes]) -> Callable[[int, int], tuple]:
        """A function of (tree, leaf) that gives the siblings to the left and right of its path, level by level."""
        kept: dict[tuple[bool, int], tuple] = {}  # a level's last path, as leaves come in order

        def above(tree: int, level: int, index: int) -> tuple:
            """((left, right) of this node, then of its parent, ...)."""
            slot = tree == OVER, level
            if kept.get(slot, ((),))[0] != (tree, index):
                span, width = self.spans[tree], width_at(self.spans[tree].width, level)
                if width == 1:
                    found = above(OVER, 0, tree) if tree != OVER else ()
                else:
                    first = index - index % WAYS
                    run = [span.get(level, i) or spine[tree, level, i] for i in range(first, min(first + WAYS, width)) if i != index]
                    found = ((b"".join(run[: index - first]), b"".join(run[index - first :])), *above(tree, level + 1, index // WAYS))
                kept[slot] = (tree, index), found
            return kept[slot][1]

        return lambda tree, index: above(tree, 0, index)


def ranked(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with its rows' places in this order as ``at``, and their number."""
    spark, part = df.sparkSession, F.shiftright("_no", 33)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_no", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    sizes = placed.groupBy(part.alias("_part")).agg(F.min("_no").alias("_least"), F.count("*").alias("_size")).orderBy("_part").collect()  # one row a partition
    shift, total = [], 0
    for r in sizes:
        shift.append((r._part, total - r._least))
        total += r._size
    shifts = F.broadcast(spark.createDataFrame(shift, "_part long, _shift long"))  # as many rows as partitions
    return placed.withColumn("_part", part).join(shifts, "_part").withColumn("at", F.col("_no") + F.col("_shift")).drop("_part", "_no", "_shift"), total


def manifest(rows: DataFrame, group: str, order: str, chunk: int | None = None) -> DataFrame:
    """``rows`` has columns ``group``, ``order``, ``leaf`` and ``altered`` (binary digests; null where nothing is altered). To them come subroot, root, proof_sha256 and folded_root, as hex text."""
    spark = rows.sparkSession
    named = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "leaf", "altered")
    leaves, total = ranked(materialize(named, "leaves"), [F.col("_group"), F.col("_order"), F.col("leaf")], "ranked-leaves")
    groups, count = ranked(leaves.groupBy("_group").agg(F.min("at").alias("start"), F.count("*").alias("width")), [F.col("_group")], "ranked-groups")
    groups = materialize(groups.select("_group", "start", "width", F.col("at").alias("tree")), "groups")
    size = chunk or min(MOST, max(FEWEST, total // (4 * spark.sparkContext.defaultParallelism)))
    nodes = leaves.join(groups, leaves["_group"].eqNullSafe(groups["_group"])).select(leaves["_group"], "_order", "leaf", "altered", "at", "tree", "width", (F.col("at") - F.col("start")).alias("index"), F.floor((F.col("at") - (F.col("at") - F.col("start")) % BLOCK) / size).alias("chunk"))
    nodes = materialize(nodes, "nodes")
    parts = max(1, -(-total // size))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[pa.RecordBatch]]]:
        """Each chunk of the sorted batches, which start with (chunk, tree, width, index, leaf)."""
        now, held = None, []

        def done() -> tuple[Chunk, list[pa.RecordBatch]]:
            trees, widths, indexes = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2, 3))
            starts = np.flatnonzero(np.diff(trees, prepend=-2))
            leaves = [x.hex().encode() for b in held for x in b.column(4).to_pylist()]
            return Chunk(count, list(zip(starts.tolist(), trees[starts].tolist(), widths[starts].tolist(), indexes[starts].tolist(), strict=True)), leaves), held

        for batch in batches:
            at = 0
            marks = batch.column(0).to_numpy()
            while at < len(marks):
                end = at + int((marks[at:] == marks[at]).sum())
                if held and marks[at] != now:
                    yield done()
                    held = []
                now = marks[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield done()

    def unresolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunks(batches):
            forest = chunk.forest()
            rows = [(t, forest.widths[t], level, i, forest.known[t, level, i]) for t, level, i in sorted(forest.open)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tree", "width", "level", "index", "node"])

    def gathered(rows: Iterator) -> Iterator[Forest]:
        out = Forest(count)
        for tree, width, level, index, node in rows:
            out.widths[tree] = width
            out.put(tree, level, index, bytes(node))
        yield out.settled()

    dealt = nodes.repartition(min(parts, 1 << 15), "chunk").sortWithinPartitions("at")
    fragments = materialize(dealt.select("chunk", "tree", "width", "index", "leaf").mapInArrow(unresolved, "tree long, width long, level int, index long, node binary"), "fragments")
    whole = fragments.rdd.mapPartitions(gathered).treeReduce(lambda a, b: a + b) if total else Forest(0)  # ends with the root and the spine
    spine = spark.sparkContext.broadcast(whole.known)
    top = next((whole.known[k].decode() for k in whole.open), None)

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in chunks(batches):
            path = chunk.paths(spine.value)
            subroots = {t: (s.root() or spine.value[OVER, 0, t]).decode() for t, s in chunk.spans.items() if t != OVER}
            for batch in held:
                out = []
                for tree, index, leaf, altered in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True):
                    steps = path(tree, index)
                    node = (altered or leaf).hex().encode()
                    for left, right in steps:
                        node = sha256(left + node + right).hexdigest().encode()
                    out.append((subroots[tree], top, sha256(b"".join(x for step in steps for x in step)).hexdigest(), node.decode()))
                columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(7), batch.column(4), *columns], ["_group", "_order", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    kinds = dict(rows.dtypes)
    out = dealt.select("chunk", "tree", "width", "index", "leaf", "altered", "_group", "_order").mapInArrow(proven, f"_group {kinds[group]}, _order {kinds[order]}, leaf binary, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumnsRenamed({"_group": group, "_order": order})


def field(value: Column, text: Column | None = None) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string") if text is None else text
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def document_manifest(docs: DataFrame, chunk: int | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of each document; where 2 divides the crc32 of its id the text is altered by losing its newlines."""
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("source", "doc_id", row_digest([*kept, text]).alias("leaf"), F.when(touched, row_digest([*kept, F.replace(text, F.lit("\n"), F.lit(""))])).alias("altered"))
    return manifest(rows, "source", "doc_id", chunk).select("doc_id", "source", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
