import random
import zlib
from functools import cache
from hashlib import sha256
from itertools import product

import pytest

from marlstone.llm.conversations import Branch, damage, edited, repair_conversations, repaired_turns

WHITE = " \t\n\x0b\x0c\r"


def digest_of(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def faults_of(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, edits) by trying every edit of every row, from the last one back."""
    n = len(initials)

    @cache
    def best(i, last, inserts):
        found = [(0, "")] if i == n and last in ("", "a") else []
        following = "a" if last == "u" else "u"
        if inserts < 2:
            found.append(add(3, "I", best(i, following, inserts + 1)))
        if i < n:
            found.append(add(4, "D", best(i + 1, last, 0)))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                found.append(add(3 + more, "R", best(i + 1, following, 0)))
                if initials[i] == following or initials[i] == "s" and last == "":
                    found.append(add(more, "K", best(i + 1, initials[i], 0)))
        return min((f for f in found if f), default=None)

    def add(cost, edit, rest):
        return rest and (rest[0] + cost, edit + rest[1])

    return best(0, "", 0)


def brute(rows):
    """``rows``: (conv_id, turn, role, text), undamaged."""
    convs = {}
    for c, turn, role, text in rows:
        mine = convs.setdefault(c, [])
        which = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if which == 1:
            text = ""
        if which == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if which == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(which, 1)
    out = []
    for c, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest_of(r[1], r[2])))
        turns = {t for t, _, _ in mine if t is not None}
        faults = faults_of([r[1:] for r in mine])
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in mine]
        cost, edits = cheapest(initials, faults)
        whole, last, left = [], "", [r[1:] for r in mine]
        for e in edits:
            role, text = ("", "") if e == "I" else left.pop(0)
            if e != "D":
                last = role[0] if e == "K" else "a" if last == "u" else "u"
                whole.append((role if e == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + text)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha256("\n".join(whole).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs=60):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "u2", "tool", "", None]
    texts = ["Yes.", "No!", "why?", "cut", "", " \t", "\xa0", "é.", "é. \n", None, "a\nb."]
    rows = [(None, 0, "user", "x."), (None, None, "assistant", "y."), (None, 3, None, None), (-4, None, "user", "x."), (-4, None, "user", "x.")]
    for c in range(convs):
        turn = rnd.randrange(-2, 3)
        for k in range(rnd.randrange(1, 12)):
            role = ("user", "assistant")[k % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            text = f"{c} {k} said." if rnd.random() < 0.5 else rnd.choice(texts)
            rows.append((c, None if rnd.random() < 0.08 else turn, role, text))
            turn += rnd.choice([0, 1, 1, 1, 2])
    rows += [rows[9], rows[9], rows[30]]
    dropped = next(k for k in range(1000, 9000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    rnd.shuffle(rows)
    return rows


KINDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS + ", copies int, audit string").repartition(6)
    got = repair_conversations(damage(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_every_short_spelling_against_all_edits():
    letters = [(i, f) for i in "sua?" for f in ("", "truncated")] + [("u", "blank"), ("a", "duplicate")]
    branch, found, faults = Branch(), {}, ["", "blank", "duplicate", "truncated"]
    spelled = {}
    for n in range(5):
        for word in product(letters, repeat=n):
            spelled["".join(chr(ord("a") + 4 * faults.index(f) + "sua?".index(i)) for i, f in word)] = word
    for s in sorted(spelled):
        found[s] = branch.answer(s)
    for s, word in spelled.items():
        assert found[s][4:] == cheapest([i for i, _ in word], [f for _, f in word]), word
    assert branch.made == len(spelled) - 1  # each prefix once
    assert len(branch.layers.known) < 2000


def test_longer_spellings_against_all_edits():
    rnd = random.Random(4)
    faults = ["", "blank", "duplicate", "truncated"]
    words = [[(rnd.choice("suuaa?"), rnd.choice(["", "", "", *faults])) for _ in range(rnd.randrange(5, 40))] for _ in range(400)]
    spelled = {"".join(chr(ord("a") + 4 * faults.index(f) + "sua?".index(i)) for i, f in w): w for w in words}
    branch = Branch()
    for s in sorted(spelled):
        w = spelled[s]
        assert branch.answer(s)[4:] == cheapest([i for i, _ in w], [f for _, f in w])


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame(made(3), KINDS)
    turns, whole = {}, {}
    for r in sorted(repaired_turns(damage(df)).collect(), key=lambda r: (str(r.conv_id), r.turn)):
        turns.setdefault(r.conv_id, []).append(r.role[0])
        whole.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all("".join(t).removeprefix("s") == "ua" * (len(t) // 2) for t in turns.values())
    for r in repair_conversations(damage(df)).collect():
        assert r.repaired_sha256 == sha256("\n".join(whole.get(r.conv_id, [])).encode()).hexdigest()


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(30_000)] + [(2, 0, "user", "long " * 500_000)]
    rows += [(3, 7, "user", "Again."), *((3, t, "user", "Again.") for t in range(8, 120))]
    got = {r.conv_id: r for r in repair_conversations(damage(spark.createDataFrame(rows, KINDS).repartition(8))).collect()}
    want = {r[0]: r for r in brute([r for r in rows if r[0] != 1])}
    assert tuple(got[2]) == want[2] and got[3].duplicate == want[3][3] and got[3].gaps == want[3][1]
    which = [zlib.crc32(f"1:{t}".encode()) % 20 for t in range(30_000)]
    assert (got[1].blank, got[1].duplicate, got[1].truncated) == tuple(which.count(k) for k in (1, 3, 2))


def test_edits_are_read_in_order():
    assert list(edited("IKDR", iter([("assistant2", "x"), ("user", "y"), ("user", "z")]))) == [("user", ""), ("assistant2", "x"), ("user", "z")]


def test_empty_table(spark):
    assert repair_conversations(damage(spark.createDataFrame([], KINDS))).count() == 0
