import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from marlstone.llm.bpe import OpenWord, Tokenizer, bpe_ids, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


TEXTS = [
    "",
    "   ",
    "Hello, World's DON'T they'll 123 4a5!!",
    "a\x1cb\x85c d e",
    "ΟΔΟΣ İstanbul ﬁne été ǅ ½ Ⅷ ²",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|endof",
    "日本語のテキスト 한국어 한 العربية 🎉🎉 👩‍👩‍👧 힣",
    "a'sb ''s !'s 'S 'LL 're",
    "ͅα ᾳ Å",
]


def ids_of(t, text):
    return np.frombuffer(b"".join(t.encode(text)), "<u4").tolist()


@pytest.mark.parametrize("block", [1 << 16, 24])
def test_ids_and_decoding_match_the_library(library, block):
    t = Tokenizer(PATH, block)
    rnd = random.Random(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC  \n'<|>.,0123éßñçΣσ中文🎉́")
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randrange(200))) for _ in range(150)]
    texts += ["".join(rnd.choices("thearonidse", k=6000)), "ab" * 3000, "a" * 5000, "7" * 3000, "!?" * 2000, "中" * 900]
    for text in texts:
        want = library.encode(text, add_special_tokens=False)
        got = ids_of(t, text)
        assert got == want.ids, (block, text[:80])
        assert "".join(t.decode(t.encode(text))) == library.decode(want.ids, skip_special_tokens=False)


def test_open_word_emits_early_and_holds_little(library):
    t = Tokenizer(PATH)
    rnd = random.Random(9)
    word, out, held = OpenWord(t.merges), [], 0
    text = "".join(rnd.choices("etaoinshrdlu", k=20000))
    for i in range(0, len(text), 50):
        out += word.feed(text[i : i + 50])
        held = max(held, len(word.held))
    assert held <= 4 * t.merges.lookahead + 64 + 50
    assert out + word.close() == library.encode(text, add_special_tokens=False).ids


def test_runs_of_marks_are_cut(library):
    t = Tokenizer(PATH, 256)
    rnd = random.Random(4)
    for alphabet in ("!?.,;:-", "🎉😀=+", "½²³", "٣٤٥"):
        text = "".join(rnd.choices(alphabet, k=20_000))
        assert max(len(block) for block, *_ in t._spans(text)) <= 2 * 256
        assert ids_of(t, text) == library.encode(text, add_special_tokens=False).ids
    mixed = "".join(rnd.choices("!?'s<|>x ", k=4000))
    assert ids_of(t, mixed) == library.encode(mixed, add_special_tokens=False).ids


def test_operator(spark, library):
    texts = [None, *TEXTS]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "", "x"), (None, "null id", "x")], "doc_id long, text string, n_tokens string")
    rows = bpe_round_trip(docs, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = {r.doc_id: r for r in bpe_ids(docs, PATH).collect()}
    assert got[3].decoded == "hello , world 's don 't they 'll 1 2 3 4 a 5 !! "


def test_empty_table(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
