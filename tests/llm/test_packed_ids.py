import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from marlstone.llm.common import fresh_path
from marlstone.llm.packed_ids import BLOCK, ByteBpe, PackedFile, PackedWriter, pack, read_packed, unpack, write_packed

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32, 33, 63])
def test_packing_round_trip(width):
    rnd = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rnd.integers(0, 1 << width, n, dtype=np.uint64)
        data = pack(ids, width)
        assert len(data) == -(-n // 64) * 8 * width
        assert (unpack(data, width, n) == ids).all()


def test_random_access():
    rnd = np.random.default_rng(1)
    out, want = io.BytesIO(), []
    w = PackedWriter(out, 17)
    for d in range(40):
        ids = rnd.integers(0, 1 << 17, int(rnd.integers(0, 60000)) if d % 5 else 0, dtype=np.uint64)
        want.append(ids)
        w.add(d, ids)
    w.close()
    f = PackedFile(io.BytesIO(out.getvalue()), len(out.getvalue()))
    everything = np.concatenate(want)
    assert f.n == len(everything) and len(f.blocks) == -(-f.n // BLOCK)
    for _ in range(50):
        a = int(rnd.integers(0, f.n))
        n = int(rnd.integers(0, 30000))
        assert (f.ids(a, n) == everything[a : a + n]).all()


def test_ids_match_the_library():
    library, own = Library.from_file(PATH), ByteBpe(PATH)
    rnd = random.Random(3)
    alphabet = list("abcdeXYZ    \n\n\t'sdt<|>.,0123éß́Σ中🎉\x85\xa0 \x1c")
    texts = ["", " ", "\n\n a", "a  b", "a \n b", "it's  don't 'll", "x<|endoftext|> y<|endof", "a_b __ ½x ²³ Ⅷ 九9 ٣٤", "_x1_ \x1f\x1ca"] + ["".join(rnd.choices(alphabet, k=rnd.randrange(150))) for _ in range(400)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_ranges_split_alike():
    library, own = Library.from_file(PATH), ByteBpe(PATH)
    rnd = random.Random(5)
    for c in map(chr, range(0x260)):
        t = f"a{c}b {c}{c} 1{c}2 '{c} .{c}, {c}"
        assert own.pieces(t) == own.PIECES.findall(t) and "".join(own.pieces(t)) == t, repr(t)
    texts = ["".join(chr(rnd.choice([rnd.randrange(0x80), rnd.randrange(0x250), 32, 39, 115])) for _ in range(rnd.randrange(200))) for _ in range(500)]
    texts += ["é" * 5000 + " " + "ab" * 3000, "x" * 4095, "x" * 4096, " " * 9000]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert own.pieces(t) == own.PIECES.findall(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_operator(spark):
    library = Library.from_file(PATH)
    rnd = random.Random(8)
    rows = [(i, None if i % 7 == 0 else " ".join(rnd.choices(["a", "the", "Xé", "\n"], k=rnd.randrange(40))), "x") for i in rnd.sample(range(-50, 500), 90)]
    rows += [rows[3], (1000, "long text " * 5000, "x"), (None, "a", "x"), (None, "longer one", "x"), (7000, "a", "x")]
    folder = fresh_path(spark, "packed-test")
    got = read_packed(write_packed(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5), PATH, folder), folder).collect()
    hashed = {("doc", r.t): r.h for r in spark.sql("select t, xxhash64(t) h from values ('a'), ('longer one') as v(t)").collect()}
    want, at = [], 0
    unnamed = sorted([r for r in rows if r[0] is None], key=lambda r: hashed["doc", r[1]])
    for d, t, _ in unnamed + sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_equal_ids_keep_one_order(spark):
    rows = [(5, f"text {i}") for i in range(6)]
    found = []
    for parts in (1, 4):
        folder = fresh_path(spark, "packed-test")
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts)
        found.append(sorted(map(tuple, read_packed(write_packed(df, PATH, folder), folder).collect())))
    assert found[0] == found[1]


def test_other_splitting_is_refused():
    with pytest.raises(ValueError, match="split"):
        ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(spark):
    folder = fresh_path(spark, "packed-test")
    assert read_packed(write_packed(spark.createDataFrame([], "doc_id long, text string"), PATH, folder), folder).count() == 0
