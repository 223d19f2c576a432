"""Benchmark decontamination under edit distance, by CGK embedding and bit sampling.

Texts are sequences of words, lower-cased and without punctuation. An item of n
words leaks into a document if some stretch of it is within ``share`` * n word
edits of the item.

The CGK embedding reads a sequence by a random walk (each step outputs the
current word; a random bit of that word and step says whether to move on), so
a small edit distance becomes a small Hamming distance. Windows of an item's
size are embedded; tables of a few sampled positions find items whose embedding
agrees there. Walks are added for each item length by itself until trial edits
of its items, at the largest distance allowed, are found with the wanted recall.
Where walks stop finding more before that (``patience`` of them leave half of
what was missing, or more), the length is held exactly: every window with enough of an
item's own word pairs is a candidate. Candidates are then verified by the exact
edit distance to the best stretch near the window.

Only windows that can be near an item are embedded: by the q-gram lemma a
stretch within k edits keeps n - 1 - 2k of the item's word pairs, so a window
that begins there holds n - 1 - 3k pairs of items of that size. This loses
nothing.

Benchmark items are a stated query set: they are taken in blocks of bounded
size, each block sent to all tasks and held against all rows in one scan.

Defined results: null and empty texts leak nothing and items under
``least_words`` words are not looked for. Items with equal words are all
reported. Each row of the documents is judged by itself, repeats and rows without
an id included. Of stretches with equally few edits the first is reported. A very
long text is one task's, with its word codes. An empty table, or an empty benchmark,
gives no leaks. Other columns are not read, whatever their names (``without_leaks``
returns them unchanged).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, item_id long, edits long, n_item_words long, start long, stop long"
PLAIN = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_BYTES = 6_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_word(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else PLAIN.sub("", word)


class Codes(dict):
    """Raw word -> its code: above 0 in the vocabulary, 0 outside, -1 for no word at all. Forgets all at ``limit``."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 400_000) -> None:
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = plain_word(raw.decode("utf-8", "replace"))
        code = self[raw] = self.vocabulary.get(word, 0) if word else -1
        return code


def edit_distance(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits from ``pattern`` to a stretch of ``text``, and where the first best stretch ends."""
    along = np.arange(len(pattern) + 1)
    column, best, end = along.copy(), len(pattern), 0
    for j, c in enumerate(text.tolist()):
        step = np.empty_like(column)
        step[0] = 0
        np.minimum(column[:-1] + (pattern != c), column[1:] + 1, out=step[1:])
        column = np.minimum.accumulate(step - along) + along
        if column[-1] < best:
            best, end = int(column[-1]), j + 1
    return best, end


def pair_slots(codes: np.ndarray, bits: int) -> np.ndarray:
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    return ((a * MIX + b) * MIX >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Lsh:
    """Walks and tables over items (sequences of at least two codes above 0)."""

    items: list[np.ndarray]
    ids: list[list[int]]
    vocabulary: dict[str, int]
    share: float
    recall: float = 0.99
    sampled: int = 4
    tables_per_walk: int = 8
    seed: int = 17
    trials: int = 400
    patience: int = 8
    walks: dict[int, int] = field(default_factory=dict)
    reached: dict[int, float] = field(default_factory=dict)
    exact: set[int] = field(default_factory=set)
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pairs: np.ndarray | None = None
    pair_bits: int = 0
    postings: tuple[np.ndarray, np.ndarray] | None = None  # word pairs of the items held exactly, sorted, and those items

    def allowed(self, n: int) -> int:
        return int(self.share * n)

    def fit(self) -> Lsh:
        self.lengths = sorted({len(x) for x in self.items})
        self.pair_bits = max(16, (32 * sum(map(len, self.items))).bit_length())
        self.pairs = np.zeros(1 << self.pair_bits, np.uint64)  # a bit for each class of lengths that has the pair
        for x in self.items:
            self.pairs[pair_slots(x, self.pair_bits)] |= np.uint64(1 << self.lengths.index(len(x)) % 64)
        rng = np.random.default_rng(self.seed)
        by_length = {n: [i for i, x in enumerate(self.items) if len(x) == n] for n in self.lengths}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)  # walk -> (items, their keys) of each length that has it
        for n, members in by_length.items():
            origin = np.repeat(np.arange(len(members)), max(2, -(-self.trials // len(members))))
            trials, _, begin = self._rows([self._edited(self.items[members[i]], rng) for i in origin.tolist()])
            flat, size, starts = self._rows([self.items[i] for i in members])
            found, missing = np.zeros(len(origin), bool), [1.0]
            mine = []
            while not self._reached(found) and n not in self.exact:
                keys = self._embed(flat, starts, size, len(mine))
                found |= (self._embed(trials, begin, size[origin], len(mine)) == keys[origin]).any(axis=1)
                mine.append((np.array(members, np.int64), keys))
                missing.append(1 - float(found.mean()))
                if not self._reached(found) and len(mine) >= self.patience and missing[-1] >= missing[-1 - self.patience] / 2:
                    self.exact.add(n)
            self.reached[n] = float(found.mean())
            self.walks[n] = 0 if n in self.exact else len(mine)
            for w in range(self.walks[n]):
                parts[w].append(mine[w])
        for w in range(len(parts)):
            members, keys = (np.concatenate(x) for x in zip(*parts[w], strict=True))
            for t in range(self.tables_per_walk):
                order = np.argsort(keys[:, t], kind="stable")
                self.tables.append((keys[order, t], members[order]))
        held = [(self._exact_pairs(x), i) for n in sorted(self.exact) for i in by_length[n] for x in [self.items[i]]]
        pair = np.concatenate([p for p, _ in held]) if held else np.empty(0, np.int64)
        owner = np.concatenate([np.full(len(p), i, np.int64) for p, i in held]) if held else np.empty(0, np.int64)
        order = np.argsort(pair, kind="stable")
        self.postings = pair[order], owner[order]
        return self

    def _reached(self, found: np.ndarray) -> bool:
        """Whether the trials found vouch for the recall: their misses, raised to about 95 % confidence, are few enough."""
        misses = len(found) - int(found.sum())
        return misses + 2 * misses**0.5 + 3 <= (1 - self.recall) * len(found)

    def _exact_pairs(self, codes: np.ndarray) -> np.ndarray:
        return np.unique(codes[:-1] * (len(self.vocabulary) + 1) + codes[1:])

    @staticmethod
    def _rows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All sequences in one array with room after each; their sizes and starts."""
        size = np.array([len(x) for x in sequences], np.int64)
        gap = int(size.max(initial=0)) * 2 + 2
        starts = np.concatenate([[0], np.cumsum(size + gap)])[: len(size)]
        flat = np.zeros(int((size + gap).sum()) + 1, np.int64)
        for x, a in zip(sequences, starts.tolist(), strict=True):
            flat[a : a + len(x)] = x
        return flat, size, starts

    def _edited(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        y = x.tolist()
        for _ in range(self.allowed(len(x))):
            at, kind = int(rng.integers(0, max(1, len(y)))), int(rng.integers(0, 3))
            if kind == 0 and y:
                y[at] = 0
            elif kind == 1:
                y.insert(at, 0)
            elif len(y) > 1:
                del y[at]
        return np.array(y, np.int64)

    def _embed(self, codes: np.ndarray, starts: np.ndarray, size: np.ndarray, walk: int) -> np.ndarray:
        """Keys of the tables of one walk for the windows of ``size`` codes at ``starts``: sampled outputs and size, hashed."""
        rng = np.random.default_rng([self.seed, walk])
        steps = 2 * int(size.max(initial=1))
        share = rng.random((self.tables_per_walk, self.sampled))
        factor = rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64)[np.arange(steps) % (1 << 16)] | np.uint64(1)
        said = np.empty((steps, len(starts)), np.int32)
        at, last, top = starts.copy(), len(codes) - 1, np.uint64(63)
        stop = starts + size
        for j in range(steps):
            x = codes.take(at, mode="clip") if last >= 0 else np.zeros(len(at), np.int64)
            x *= at < stop
            said[j] = x
            x += 1
            move = x.view(np.uint64)
            move *= factor[j]
            move += factor[j]
            move >>= top
            at += x
        keys = np.empty((len(starts), self.tables_per_walk), np.uint64)
        rows = np.arange(len(starts))
        for t in range(self.tables_per_walk):
            key = size.astype(np.uint64) * MIX
            for s in share[t]:
                key = (key + said[(s * 2 * size).astype(np.int64), rows].astype(np.uint64) + np.uint64(1)) * MIX
            keys[:, t] = key
        return keys

    def candidates(self, codes: np.ndarray) -> dict[int, list[int]]:
        """Item -> starts of windows that agree with it in some table, or for lengths held exactly hold enough of its pairs. ``codes`` ends in zeros, more than the longest item has words."""
        marks = self.pairs[pair_slots(codes, self.pair_bits)]
        marks[(codes[:-1] == 0) | (codes[1:] == 0)] = 0
        where = np.flatnonzero(marks)
        marks = marks[where]
        out: dict[int, set[int]] = defaultdict(set)
        if self.exact:
            self._exact_candidates(codes, where, out)
        starts, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c, n in enumerate(self.lengths):
            if n in self.exact:
                continue
            need = max(1, n - 1 - 3 * self.allowed(n))
            at = where[(marks >> np.uint64(c % 64) & np.uint64(1)).astype(bool)]
            dense = np.flatnonzero(at[need - 1 :] - at[: max(0, len(at) - need + 1)] <= n - 2)  # so many pairs in one window
            spans = [np.arange(max(0, b - n + 2), a + 1) for a, b in zip(at[dense].tolist(), at[dense + need - 1].tolist(), strict=True)]
            fit = np.unique(np.concatenate(spans)) if spans else np.empty(0, np.int64)
            starts.append(fit)
            sizes.append(np.full(len(fit), n, np.int64))
        start, size = np.concatenate(starts), np.concatenate(sizes)
        low = 0
        while low < len(start):  # windows of like sizes together, for they take as many steps as the longest
            high = min(low + 50_000, int(np.searchsorted(size, size[low] * 5 // 4, "right")))
            a, n = start[low:high], size[low:high]
            low = high
            walks = np.array([self.walks[x] for x in self.lengths])[np.searchsorted(self.lengths, n)]
            for w in range(int(walks.max())):
                more = walks > w
                if not more.all():
                    a, n, walks = a[more], n[more], walks[more]
                rows = self._embed(codes, a, n, w)
                for t in range(self.tables_per_walk):
                    keys, members = self.tables[w * self.tables_per_walk + t]
                    left, right = np.searchsorted(keys, rows[:, t]), np.searchsorted(keys, rows[:, t], "right")
                    for i in np.flatnonzero(right > left):
                        for m in members[left[i] : right[i]].tolist():
                            out[m].add(int(a[i]))
        return {m: sorted(s) for m, s in out.items()}

    def _exact_candidates(self, codes: np.ndarray, where: np.ndarray, out: dict[int, set[int]]) -> None:
        """Adds all windows that hold as many of an item's own pairs as the lossless bound asks for; ``where`` has all pairs of items."""
        pair, owner = self.postings
        base = len(self.vocabulary) + 1
        step = max(1, 4_000_000 // max(1, len(self.items)))
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        for low in range(0, len(where), step):  # so many at once that their postings stay of bounded size
            at = where[low : low + step]
            key = codes[at] * base + codes[at + 1]
            left, many = np.searchsorted(pair, key), np.searchsorted(pair, key, "right")
            many -= left
            spot = np.repeat(at, many)
            item = owner[np.repeat(left - np.cumsum(many) + many, many) + np.arange(len(spot))]
            order = np.argsort(item, kind="stable")
            item, spot = item[order], spot[order]
            edges = np.flatnonzero(np.diff(item, prepend=-1))
            for i, some in zip(item[edges].tolist(), np.split(spot, edges[1:]) if len(edges) else [], strict=True):
                places[i].append(some)
        for i, some in places.items():
            at, n = np.concatenate(some), len(self.items[i])
            need = max(1, n - 1 - 3 * self.allowed(n))
            dense = np.flatnonzero(at[need - 1 :] - at[: max(0, len(at) - need + 1)] <= n - 2)
            for a, b in zip(at[dense].tolist(), at[dense + need - 1].tolist(), strict=True):
                out[i].update(range(max(0, b - n + 2), a + 1))

    def verify(self, item: int, codes: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
        """Fewest edits of the item near the windows, with the words where that stretch begins and ends."""
        x = self.items[item]
        n, k = len(x), self.allowed(len(x))
        best = None
        at = 0
        while at < len(starts):
            first, begin = starts[at], at
            last = first
            while at < len(starts) and starts[at] - last <= n:
                last = starts[at]
                at += 1
            low, high = max(0, first - 2 * k), min(len(codes), last + n + 2 * k)
            if np.isin(codes[low:high], x).sum() < n - k:  # too few of its words for so few edits
                continue
            exact = next((s for s in starts[begin:at] if np.array_equal(codes[s : s + n], x)), None)
            if exact is not None:
                return 0, exact, exact + n
            edits, end = edit_distance(x, codes[low:high])
            if edits <= k and (best is None or edits < best[0]):
                _, back = edit_distance(x[::-1], codes[max(0, low + end - n - k) : low + end][::-1])
                best = (edits, low + end - back, low + end)
        return best


class Scanner:
    """Leaks of one block of items in texts."""

    def __init__(self, lsh: Lsh) -> None:
        self.lsh, self.codes = lsh, Codes(lsh.vocabulary)
        self.gap = max(map(len, lsh.items)) + 1

    def _group(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, item, edits, first word, word after) of each leak."""
        parts, bounds, at = [], [], 0
        for t in texts:
            words = t.split()
            c = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            c = c[c >= 0]
            bounds.append((at, at + len(c)))
            parts += [c, np.zeros(self.gap, np.int64)]
            at += len(c) + self.gap
        every = np.concatenate(parts)
        edges = np.array([b for b, _ in bounds])
        for item, starts in self.lsh.candidates(every).items():
            owner = np.searchsorted(edges, starts, "right") - 1
            for d in np.unique(owner).tolist():
                low, high = bounds[d]
                mine = [s - low for s, o in zip(starts, owner.tolist(), strict=True) if o == d]
                if hit := self.lsh.verify(item, every[low:high], mine):
                    yield d, item, *hit

    def leaks(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """As ``_group``, over groups of texts of bounded size."""
        numbers, size = [], 0
        for i, t in enumerate(texts):
            if t:
                numbers.append(i)
                size += len(t)
            if numbers and (size > BATCH_BYTES or i + 1 == len(texts)):
                yield from ((numbers[d], *rest) for d, *rest in self._group([texts[n] for n in numbers]))
                numbers, size = [], 0


def _scan(lsh: Lsh, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(lsh)
    for batch in batches:
        ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), []
        for d, item, edits, a, b in scanner.leaks(texts):
            spans = [m.span() for m in WORD.finditer(texts[d].decode("utf-8", "replace")) if plain_word(m[0])]
            rows += [(ids[d], i, edits, len(lsh.items[item]), spans[a][0] if a < b else 0, spans[b - 1][1] if a < b else 0) for i in lsh.ids[item]]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def item_blocks(items: DataFrame, share: float, least_words: int, block_words: int) -> Iterator[Lsh]:
    """Fitted tables for blocks of items of about ``block_words`` words each."""
    found: dict[tuple[str, ...], list[int]] = {}
    held = 0

    def fitted() -> Lsh:
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64) for words in found]
        return Lsh(coded, list(found.values()), vocabulary, share).fit()

    for row in items.toLocalIterator():
        words = tuple(w for w in (plain_word(m[0]) for m in WORD.finditer(row.text or "")) if w)
        if len(words) >= max(2, least_words):
            found.setdefault(words, []).append(row.item_id)
            held += len(words)
        if held >= block_words:
            yield fitted()
            found.clear()
            held = 0
    if found:
        yield fitted()


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, least_words: int = 5, block_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, n_item_words, start, stop) of each leak; offsets in code points."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for lsh in item_blocks(items, share, least_words, block_words):
        sent = spark.sparkContext.broadcast(lsh)
        part = rows.mapInArrow(lambda batches, sent=sent: _scan(sent.value, batches), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, least_words: int = 5, block_words: int = 100_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    at = docs.columns.index(text_col)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in batches:
            bad = {d for d, *_ in scanner.leaks(batch.column(at).cast(pa.binary()).to_pylist())}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    for lsh in item_blocks(items, share, least_words, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(lsh)
        docs = docs.mapInArrow(lambda batches, sent=sent: keep(batches, sent), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
