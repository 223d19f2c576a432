"""BPE encoding and decoding as streaming transducers.

Encoding. A text passes through in blocks. Blocks end where no special token,
composition or piece of the pre-tokenizer can straddle the cut; a cut inside a
long run of letters, or of punctuation and symbols, leaves its word open. Tokens of
an open word are emitted once stable: ``lookahead`` computes from the merge list how
far to the left an unknown continuation can reach, and what ends before that is
final. So memory depends on the merge list and the block size, not on the text (but
for a run of combining marks, which no cut may part).

Why the bound holds: apply the merges in order to a known prefix with an
unknown rest. What depends on the rest is a suffix of the prefix, at first
empty. A merge (u, v) can extend it only by one token, u, and only if the
suffix (or the rest) may begin with v, so v is built, leftmost, from the token
that was added last. The longest such chain is found by one pass over the list.

Decoding. Ids become byte strings that an incremental UTF-8 decoder turns into
text, holding back unfinished characters. A tokenizer file without a decoder
joins its tokens by spaces, as its library does; ``as_text`` gives plain text.

Defined results: a null text counts as empty; an empty text has no ids and the
empty digest. Ids (null ones too) and order of rows are as in the input, repeats
included. An empty table gives no rows. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode's White_Space, which Python's own \s exceeds.
WHITE = "\t-\r \x85\xa0  -     　"
MEMO_WORDS = 400_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stay, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Merges:
    """The merge list by pairs of ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.pairs: list[tuple[int, int, int]] = []
        for m in merges:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.rank = {(a << 32) | b: (r, c) for r, (a, b, c) in reversed(list(enumerate(self.pairs)))}
        names = {v: k for k, v in vocab.items()}
        self.length = {i: len(s.removesuffix(suffix)) if suffix else len(s) for i, s in names.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Most characters before an unknown rest whose tokens the rest may change."""
        left = {c: a for a, _, c in reversed(self.pairs)}
        reach: dict[int, int] = {}
        for a, b, _ in self.pairs:
            x, far = b, reach.get(b, 0)
            while x in left:
                x = left[x]
                far = max(far, reach.get(x, 0))
            reach[a] = max(reach.get(a, 0), self.length[a] + far)
        return max(reach.values(), default=0)

    def apply(self, ids: list[int]) -> list[int]:
        """Merge by rank, leftmost first."""
        rank = self.rank
        if len(ids) > 48:
            return self._apply_long(ids)
        ids = list(ids)
        found = [rank.get((a << 32) | b) for a, b in pairwise(ids)]
        while True:
            best = min((f for f in found if f), default=None)
            if best is None:
                return ids
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = rank.get((ids[i - 1] << 32) | ids[i])
            if i < len(found):
                found[i] = rank.get((ids[i] << 32) | ids[i + 1])

    def _apply_long(self, ids: list[int]) -> list[int]:
        ids, rank, n = list(ids), self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := rank.get((ids[i] << 32) | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if f := rank.get((c << 32) | ids[k]):
                    heapq.heappush(heap, (f[0], i, c, ids[k], f[1]))
            if (h := before[i]) >= 0 and (f := rank.get((ids[h] << 32) | c)):
                heapq.heappush(heap, (f[0], h, ids[h], c, f[1]))
        return [x for x in ids if x >= 0]


class OpenWord:
    """Transducer for one word: ``feed`` characters, get stable ids; ``close`` gives the rest."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, ""

    def feed(self, chars: str) -> list[int]:
        self.held += chars
        m = self.merges
        if len(self.held) < 4 * m.lookahead + 64:
            return []
        known = self.held[:-1]  # the last character might end the word
        limit, end, out = len(known) - m.lookahead, 0, []
        for t in m.apply([m.vocab[c] for c in known]):
            if end + m.length[t] > limit:
                break
            end += m.length[t]
            out.append(t)
        self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        m, held = self.merges, self.held
        self.held = ""
        return m.apply([*(m.vocab[c] for c in held[:-1]), m.vocab[held[-1] + m.suffix]]) if held else []


class Tokenizer:
    """What a tokenizer file of the kind "BPE with word ends" says: normalize, split, merge, decode."""

    def __init__(self, path: str, block: int = 1 << 16) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=1)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE) if "[^\\s" in split else split)
        self.alphabet = byte_alphabet()
        self.spaces = re.compile(f"[{WHITE}]+")
        self.block = block
        self.memo: dict[str, bytes] = {}
        back = {c: b for b, c in self.alphabet.items()}
        self.joined = spec.get("decoder") is None
        self.names: dict[int, bytes] = {}
        self.bytes_of: dict[int, bytes] = {}
        suffix = self.merges.suffix
        for s, i in (model["vocab"] | self.special).items():
            self.names[i] = s.encode()
            core = s.removesuffix(suffix) if suffix else s
            self.bytes_of[i] = s.encode() if s in self.special else bytes(back[c] for c in core) + (b" " if suffix and s.endswith(suffix) else b"")

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # Sigma: each character by itself, not by its place in a word
        return text.lower()

    def _mapped(self, piece: str) -> str:
        return "".join(map(self.alphabet.__getitem__, piece.encode()))

    def _word(self, piece: str) -> bytes:
        """Ids of a whole piece as little-endian 32-bit integers; remembered if short."""
        word = OpenWord(self.merges)
        chars = self._mapped(piece)
        ids = [t for i in range(0, len(chars), self.block) for t in word.feed(chars[i : i + self.block])] + word.close()
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def _cut(self, text: str) -> tuple[int, bool]:
        """Where a block may end, and whether that leaves a word open. 0: nowhere."""
        for at in range(len(text) - 1, max(0, len(text) - 4096), -1):
            if text[at] in " \n\t\r":
                return at, False
        for at in range(len(text) - self.longest_special, self.longest_special, -1):
            x, y = text[at - 1], text[at]
            around = text[at - self.longest_special : at + self.longest_special]
            kinds = unicodedata.category(x), unicodedata.category(y)
            if kinds[0][0] == kinds[1][0] == "N" and "<" not in around:
                return at, False
            if all(k[0] in "PS" or k in ("Cf", "Co", "Cn") for k in kinds) and "'" not in around and "<" not in around and ">" not in around:
                return at, True
            if x.isalpha() and y.isalpha() and not "ᅠ" <= y <= "ᇿ" and "'" not in around and "<" not in around:
                return at, True
        return 0, False

    def _spans(self, text: str) -> Iterator[tuple[str, bool, bool]]:
        """(block, whether it goes on with an open word, whether it leaves one open)."""
        at, start, goes_on = 0, 0, False
        size = self.block
        while len(text) - start > 2 * size:
            at, leaves = self._cut(text[start : start + size])
            if not at:
                size *= 2
                continue
            yield text[start : start + at], goes_on, leaves
            start, goes_on, size = start + at, leaves, self.block
        yield text[start:], goes_on, False

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of ``text`` as little-endian 32-bit integers, in parts."""
        if len(text) <= 2 * self.block and "<|" not in text:
            yield self._plain(self._normal(text))
            return
        word: OpenWord | None = None
        for block, goes_on, leaves in self._spans(text):
            segments = self.special_split.split(block) if self.special_split else [block]
            for k, segment in enumerate(segments):
                if k % 2:
                    yield np.array([self.special[segment]], "<u4").tobytes()
                    continue
                pieces = self.pieces.findall(self.spaces.sub(" ", self._normal(segment)))
                first, last = k == 0 and goes_on, k == len(segments) - 1 and leaves
                for j, piece in enumerate(pieces):
                    opened, left = first and j == 0, last and j == len(pieces) - 1
                    if opened or left:
                        word = word if opened and word else OpenWord(self.merges)
                        yield np.array(word.feed(self._mapped(piece)), "<u4").tobytes()
                        if not left:
                            yield np.array(word.close(), "<u4").tobytes()
                            word = None
                    else:
                        yield self.memo.get(piece) or self._word(piece)

    def _plain(self, normal: str) -> bytes:
        memo, word = self.memo, self._word
        return b"".join([memo.get(p) or word(p) for p in self.pieces.findall(normal)])

    def decode(self, parts: Iterable[bytes], as_text: bool | None = None) -> Iterator[str]:
        """Text of ids in parts, through a UTF-8 decoder that holds back unfinished characters."""
        plain = not self.joined if as_text is None else as_text
        table, glue = (self.bytes_of, b"") if plain else (self.names, b" ")
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        begun = False
        for part in parts:
            if part:
                ids = np.frombuffer(part, "<u4").tolist()
                yield machine.decode((glue if begun else b"") + glue.join(map(table.__getitem__, ids)))
                begun = True
        yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path)


def _digests(t: Tokenizer, text: str, held: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number and digest of the ids, digest of their decoding; ``held`` gets the ids themselves."""
    ids, out, n = hashlib.sha256(), hashlib.sha256(), 0

    def counted() -> Iterator[bytes]:
        nonlocal n
        for part in t.encode(text):
            ids.update(part)
            n += len(part) // 4
            if held is not None:
                held.append(part)
            yield part

    for s in t.decode(counted()):
        out.update(s.encode())
    return n, ids.hexdigest(), out.hexdigest()


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and digest of the ids of each text, digest of their decoding, and at wish the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            ids: list[np.ndarray] = []
            rows = []
            for x in batch.column(1).to_pylist():
                held: list[bytes] | None = [] if with_ids else None
                rows.append(_digests(t, x or "", held))
                if with_ids:
                    ids.append(np.frombuffer(b"".join(held), "<i4"))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digest, SCHEMA + ", ids array<int>" * with_ids)


def bpe_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the outputs themselves, where a consumer wants them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            parts = [b"".join(t.encode(x or "")) for x in batch.column(1).to_pylist()]
            ids = pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))
            text = pa.array(["".join(t.decode([p], as_text=True)) for p in parts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
