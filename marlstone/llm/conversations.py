"""Conversation structure repair: the cheapest edits that make the roles alternate.

The roles of a conversation shall read as an optional system turn and then user and
assistant in turn, ended by assistant. A row may be kept (0), given the role user or
assistant (3) or deleted (4; blank and repeated rows must be), a row without text may be
inserted anywhere (3), and a truncated row that stays costs 3 more. Of the cheapest
edits those win whose initials (Keep, Rerole, Delete, Insert) are least in ASCII.

1. Rows are reduced to (turn, initial of the role, fault) in the JVM. Equal rows are
   counted before they are shuffled; the first of those with one role and text is a
   minimum a group, met again in a join that Spark can split. A range partitioning by
   (conversation, turn) spells each conversation's letters, one a row, in pieces: a
   conversation with many rows is dealt over many tasks.
2. Distinct spellings are sorted. A task walks through its own as through a prefix trie
   of which it holds the branch to the present one: what two neighbours share is computed
   once. A node holds the layer of the dynamic programme after its letter: for each
   state (nothing yet, system, user, assistant) the least cost, and the order of the
   four cheapest texts of edits. Such layers come down to a few dozen, up to a sum,
   so each step is looked up once it has been made. Answers are read off at the
   ends of spellings, back along the branch.
3. Each conversation's edits go before its rows, and both are read in order.

The texts of a conversation pass one task in order, one batch at a time, as a digest of
them asks for; what that task holds of it is a letter or two a row.

Defined results: a null role or text is one space, in the rule for damage a null
conv_id or turn too. Rows stand by turn, nulls first, then by role and by a digest of role
and text. A null conv_id is a conversation of its own. Equal rows are repeats of each
other. Roles whose initial is none of s, u, a (an empty one too) break the alternation.
Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

WHITE = " \t\n\x0b\x0c\r"
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
NONE, SYSTEM, USER, ASSISTANT = range(4)  #: What the roles so far end with.
LEGAL = {(0, 1), (1, 2), (2, 1)}  #: Neighbouring initials, as places in ROLES.


def follower(state: int) -> int:
    """What an inserted row, or one with a new role, is after this state."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state after a row with this initial is kept, if it may be."""
    after = (SYSTEM, USER, ASSISTANT, None)[initial]
    return after if after == follower(state) or after == SYSTEM and state == NONE else None


class Layers:
    """Layers of the dynamic programme: for each state None or (cost above the least, rank of its edits among the four).

    The ranks compare texts of edits that end with a row's own letter; as all have as many
    such letters, none begins another, and whatever is added to two of them leaves their order.
    """

    START = ((0, 0), None, None, None)

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def step(self, layer: tuple, letter: int) -> tuple:
        """(next layer, what all costs rise by, for each state (state before, edits))."""
        found = self.known.get((layer, letter))
        if found is None:
            found = self.known[layer, letter] = self._made(layer, letter)
        return found

    def _made(self, layer: tuple, letter: int) -> tuple:
        fault, initial = divmod(letter, 4)
        stays = TRUNCATED if FAULTS[fault] == "truncated" else 0
        best: list[tuple | None] = [None] * 4
        for origin, held in enumerate(layer):
            if held is None:
                continue
            state = origin
            for inserts in range(3):
                ways = [("D", state, COSTS["D"])]
                if FAULTS[fault] not in ("blank", "duplicate"):
                    ways.append(("R", follower(state), COSTS["R"] + stays))
                    if (after := kept(state, initial)) is not None:
                        ways.append(("K", after, COSTS["K"] + stays))
                for edit, after, cost in ways:
                    offer = (held[0] + inserts * COSTS["I"] + cost, held[1], "I" * inserts + edit, origin)
                    if best[after] is None or offer < best[after]:
                        best[after] = offer
                state = follower(state)
        least = min(b[0] for b in best if b)
        most = (best[ASSISTANT] or (least + 99,))[0] + COSTS["D"]  # beyond it, going on from assistant is cheaper whatever comes
        best = [b if b and b[0] <= most else None for b in best]
        order = sorted((b[1:3], s) for s, b in enumerate(best) if b)
        rank = {s: i for i, (_, s) in enumerate(order)}
        return tuple(b and (b[0] - least, rank[s]) for s, b in enumerate(best)), least, tuple(b and (b[3], b[2]) for b in best)

    @staticmethod
    def ending(layer: tuple) -> tuple[int, int, int]:
        """(cost, state, inserts after the last row) of the cheapest end."""
        after = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, state = min((held[0] + after[s] * COSTS["I"], held[1], s) for s, held in enumerate(layer) if held)
        return cost, state, after[state]


class Branch:
    """The branch of a prefix trie down to the present spelling; spellings come in order."""

    def __init__(self) -> None:
        self.layers, self.spelling = Layers(), ""
        self.nodes = [(Layers.START, 0, (), (0, 0, 0, 0, 0), None)]  # layer, cost, back, times of each fault and illegal pairs, initial
        self.made = 0

    def answer(self, spelling: str) -> tuple[int, int, int, int, int, str]:
        """(blank, duplicate, truncated, illegal, cost, edits) of this spelling."""
        shared, most = 0, min(len(spelling), len(self.spelling))
        while shared < most and spelling[shared] == self.spelling[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for c in spelling[shared:]:
            layer, cost, _, seen, before = self.nodes[-1]
            fault, initial = divmod(ord(c) - ord("a"), 4)
            layer, more, back = self.layers.step(layer, ord(c) - ord("a"))
            counts = list(seen)
            counts[fault] += 1
            counts[4] += before is not None and (before, initial) not in LEGAL
            self.nodes.append((layer, cost + more, back, tuple(counts), initial))
            self.made += 1
        self.spelling = spelling
        layer, cost, _, counts, _ = self.nodes[-1]
        more, state, inserts = Layers.ending(layer)
        edits = ["I" * inserts]
        for _, _, back, _, _ in self.nodes[:0:-1]:
            state, edit = back[state]
            edits.append(edit)
        return *counts[1:], cost + more, "".join(reversed(edits))


def edited(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its rows in order and the initials of their edits."""
    state = NONE
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = (SYSTEM, USER, ASSISTANT)[ROLES.index(role[0])]
        else:
            state = follower(state)
            role = "user" if state == USER else "assistant"
        yield role, text


def same(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a role and a text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): a row in twenty is dropped (no copies), emptied, loses its ends of sentences, is repeated, or speaks as user, by the crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    which = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(which == 4, "user").otherwise(role).alias("role"),
        F.when(which == 1, "").when(which == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("copies"),
    )


def spellings(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, spelling): a letter for each row's initial and first fault; ``rows`` as from ``damage``."""
    initial, end = F.substring("role", 1, 1), F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    there = F.col("copies") > 0
    gone = lambda value, kind: F.when(there, value).otherwise(F.lit(None).cast(kind))  # noqa: E731  a conversation's dropped rows become one
    brief = rows.select(
        "conv_id",
        gone(F.col("turn"), "long").alias("turn"),
        gone(F.col("role"), "string").alias("role"),
        gone(same(F.col("role"), F.col("text")), "binary").alias("same"),
        gone(F.instr(F.lit(ROLES), F.when(initial == "", "?").otherwise(initial)), "int").alias("place"),
        gone(F.when(end == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0), "int").alias("own"),
        "copies",
    )
    counted = materialize(brief.groupBy("conv_id", "turn", "role", "same", "place", "own").agg(F.sum("copies").alias("copies")), "messages")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = counted.where("copies > 0").groupBy("conv_id", "same").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "repeated-messages").withColumnsRenamed({"conv_id": "_conv", "same": "_same"})
    met = counted.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    late = F.coalesce(order > F.col("first"), F.lit(False))
    fault = F.when(F.col("own") == 1, 1).when(late, 2).otherwise(F.col("own"))
    initial_of = F.when(F.col("place") == 0, 3).otherwise(F.col("place") - 1)
    letter = lambda fault: F.char(F.lit(ord("a")) + 4 * fault + initial_of)
    letters = met.select("conv_id", "turn", "role", "same", "copies", letter(fault).alias("letter"), letter(F.when(F.col("own") == 1, 1).otherwise(2)).alias("again"))
    by = ["conv_id", "turn", "role", "same"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each conversation of this task: (conv_id, part, piece, low, high, turns)."""
        part, now, begun, letters = TaskContext.get().partitionId(), None, False, []
        low = high = None
        turns = 0

        def done(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*found, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "piece", "low", "high", "turns"])

        for batch in batches:
            found = []
            for conv, turn, copies, letter, again in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not begun or conv != now:
                    if begun:
                        found.append((now, part, "".join(letters), low, high, turns))
                    begun, now, letters, low, high, turns = True, conv, [], None, None, 0
                if copies:
                    letters.append(letter + again * (copies - 1))
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
            yield done(found)
        if begun:
            yield done([(now, part, "".join(letters), low, high, turns)])

    placed = letters.repartitionByRange(n, *by).sortWithinPartitions(*by).select("conv_id", "turn", "copies", "letter", "again")
    pieces = placed.mapInArrow(spell, "conv_id long, part int, piece string, low long, high long, turns long")
    # A conversation has a piece a task at most; a turn that ends one and begins the next counts once.
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "low", "high", "turns"))).alias("pieces"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"))
    twice = F.size(F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.get("pieces", i)["high"] == F.get("pieces", i + 1)["low"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - twice), F.lit(0))
    return whole.select("conv_id", gaps.alias("gaps"), F.array_join(F.col("pieces.piece"), "").alias("spelling"))


def answers(spelled: DataFrame) -> DataFrame:
    """(spelling, blank, duplicate, truncated, illegal, cost, audit) of each distinct spelling."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = Branch()
        for batch in batches:
            found = [branch.answer(s) for s in batch.column(0).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["spelling", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    n = int(spelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = spelled.select("spelling").distinct().repartitionByRange(n, "spelling").sortWithinPartitions("spelling")
    return once.mapInArrow(walk, "spelling string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's answer, then its rows in order: (conv_id, the counts, audit, role, text, copies)."""
    spelled = materialize(spellings(rows), "spellings")
    solved = materialize(answers(spelled), "answers")
    heads = spelled.join(solved, "spelling")
    none = lambda kind: F.lit(None).cast(kind)
    turns = rows.where("copies > 0").select("conv_id", *(none("long").alias(c) for c in COUNTS), none("string").alias("audit"), "role", "text", F.col("copies").cast("int").alias("copies"), "turn", same(F.col("role"), F.col("text")).alias("same"))
    first = heads.select("conv_id", *COUNTS, "audit", none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copies"), none("long").alias("turn"), none("binary").alias("same"))
    return first.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "same").drop("turn", "same")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Each conversation of the ordered batches: its answer, and its rows as they come."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    head = next(rows, None)
    while head is not None:
        upcoming = None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal upcoming
            for row in rows:
                if row[7] is not None:
                    upcoming = row
                    return
                for _ in range(row[10]):
                    yield row[8], row[9]

        turns = own()
        yield head[:8], turns
        for _ in turns:  # what the reader left
            pass
        head = upcoming


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation; ``rows``: (conv_id, turn, role, text, copies), as from ``damage``."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def done() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for head, turns in _conversations(batches):
            digest, glue = sha256(), b""
            for role, text in edited(head[7], turns):
                digest.update(glue + f"{role}:{text}".encode())
                glue = b"\n"
            out.append((*head, digest.hexdigest()))
            if len(out) == 1000:
                yield done()
                out.clear()
        yield done()

    return _in_order(rows).mapInArrow(digested, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the repaired conversations, their turns counted anew from 0; ``rows`` as for ``repair_conversations``."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, turns in _conversations(batches):
            for first, block in _blocks(edited(head[7], turns)):
                roles, texts = zip(*block, strict=True)
                n = len(block)
                yield pa.RecordBatch.from_arrays([pa.array([head[0]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "turn", "role", "text"])

    return _in_order(rows).mapInArrow(told, "conv_id long, turn long, role string, text string")


def _blocks(items: Iterator, size: int = 1000) -> Iterator[tuple[int, list]]:
    at, block = 0, []
    for x in items:
        block.append(x)
        if len(block) == size:
            yield at, block
            at, block = at + size, []
    if block:
        yield at, block


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
