import random
import zlib
from hashlib import sha256

import pytest

from marlstone.llm.merkle import OVER, Chunk, Forest, Span, document_manifest, width_at

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf_of(d, s, lang, n, t):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)))


def climbed(nodes):
    """(root, for each node its (left, right) siblings by level)."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(places):
            first = at - at % 3
            run = nodes[first : first + 3]
            paths[k].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        places = [p // 3 for p in places]
    return nodes[0], paths


def brute(rows):
    """``rows``: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf_of(d, s, lang, n, t), d, t, lang, n))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    root, upper = climbed([trees[s][0] for s in order])
    out = []
    for s, over in zip(order, upper, strict=True):
        for (_, _, leaf, d, t, lang, n), path in zip(sorted(groups[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            node = leaf
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                node = leaf_of(d, s, lang, n, t and t.replace("\n", ""))
            for left, right in path + over:
                node = H(left, node, right)
            out.append((d, s, leaf, trees[s][0], root, H(*(x for step in path + over for x in step)), node, node == root))
    return sorted(out, key=str)


def made(seed, sources):
    rnd = random.Random(seed)
    rows = [(None, "a\nb", "en", None, 3), (None, "a\nb", "en", None, 3), (5, None, None, None, None), (-7, "", "é", "é", 0), (8, "x\ny", "", "", -1)]
    for d in range(sources * 6):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(["Z", "z", "ß", "\U0001f600", "~", *(f"s{i}" for i in range(sources))])
        rows.append((d * 3 - 20, rnd.choice([None, "", "no newline", "two\nlines\n", "é\n"]), rnd.choice(["en", None]), s, rnd.choice([None, 7])))
    rows += [rows[9], rows[9], rows[10]]
    rnd.shuffle(rows)
    return rows


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("sources", "chunk"), [(1, 4), (9, 5), (40, 17), (40, None)])
def test_matches_brute_force(spark, monkeypatch, sources, chunk):
    monkeypatch.setattr("marlstone.llm.merkle.BLOCK", 9 if sources == 40 else 1)
    rows = made(sources, sources)
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], KINDS + ", tree int, leaf binary").repartition(5)
    got = document_manifest(df, chunk)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(4, "a\nb", "en", "s", 3)], [(4, "a\nb", "en", None, 3), (3, "c", None, "x", 1)], [(d, "long " * 200_000, "en", "s", 9) for d in range(4)]])
def test_few_rows(spark, rows):
    assert sorted((tuple(r) for r in document_manifest(spark.createDataFrame(rows, KINDS)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert document_manifest(spark.createDataFrame([], KINDS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_forests_add_in_any_order_and_grouping(seed):
    rnd = random.Random(seed)
    widths = [rnd.choice([1, 2, 3, 4, 9, 10, 28, 100]) for _ in range(rnd.randrange(1, 12))]
    leaves = [(g, w, i, H(f"{g} {i}")) for g, w in enumerate(widths) for i in range(w)]
    cuts = sorted({0, len(leaves), *(rnd.randrange(len(leaves)) for _ in range(9))})
    forests = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = leaves[a:b]
        starts = [(k, g, w, i) for k, (g, w, i, _) in enumerate(part) if not k or part[k - 1][0] != g]
        forest = Chunk(len(widths), starts, [x.encode() for *_, x in part]).forest()
        assert len(forest.open) <= 4 * sum(width_at(w, k) > 0 for w in (max(widths), len(widths)) for k in range(6)) + 4
        forests.append(forest)
    rnd.shuffle(forests)
    while len(forests) > 1:
        i = rnd.randrange(len(forests) - 1)
        forests[i : i + 2] = [forests[i] + forests[i + 1]]
    whole = (forests[0] + Forest(len(widths))).settled()
    want = climbed([climbed([x for g, _, _, x in leaves if g == k])[0] for k in range(len(widths))])[0]
    assert [whole.known[k].decode() for k in whole.open] == [want]
    assert next(iter(whole.open))[0] == OVER


def test_span_keeps_what_no_run_holds():
    span = Span(10, 2, [str(i).encode() for i in range(2, 8)])
    assert [(level, i) for level, i, _ in span.loose()] == [(0, 2), (0, 6), (0, 7), (1, 1)]
