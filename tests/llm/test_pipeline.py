import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm.quality import quality_rules
from tests.llm.test_decontaminate import plain, slow_distance
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [(d, t) for d, t in rows if (d, d) in {(a, b) for a, b, _ in brute_groups(rows, 0.8)}]
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = plain(text)
        for item in items:
            k = int(0.2 * len(item))
            if sum(w in words for w in item) >= len(item) - k and slow_distance(item, words) <= k:
                return True
        return False

    rows = [(d, t) for d, t in rows if not leaks(t)]
    assert 20 < len(rows) < len(good) < docs.count()

    def redacted(text):
        out, at = "", 0
        for s, e in sorted((int(a), int(b)) for a, b in re.findall(r":(\d+):(\d+)", brute_spans(text))):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        return out + text[at:]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: library.encode(redacted(t), add_special_tokens=False).ids for d, t in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 40, "en", "s", 1), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()
