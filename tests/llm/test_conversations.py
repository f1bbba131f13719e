"""Operators 11 and 13 against brute force and SQL."""

import hashlib
import random
import zlib

import pytest

from gavel.llm import repair as R
from gavel.llm import trie as T

TURNS = "conv_id long, turn long, role string, text string"


def _plain(rows):
    """Every sequence of edits (up to two insertions in a row) of a small conversation, the least (cost, audit) that the grammar allows."""
    space, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for role, text in rows:
        ending = text.rstrip(space)[-1:]
        faults.append("blank" if not ending else "duplicate" if (role, text) in seen else "truncated" if ending not in ".!?" else "")
        seen.add((role, text))
    best = None

    def fits(out):
        roles = "".join(r[0] if r else "-" for r, _ in out)
        body = roles[1:] if roles.startswith("s") else roles
        return roles == "" or (body and body == "ua" * (len(body) // 2))

    def go(i, run, cost, audit, out):
        nonlocal best
        if cost > (best[0] if best else 2 * len(rows)):  # all deleted
            return
        if i == len(rows) and fits(out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        if run < 2:
            for name in ("user", "assistant"):
                go(i, run + 1, cost + 5, audit + "I", [*out, (name, "")])
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, 0, cost + 2, audit + "D", out)
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                go(i + 1, 0, cost + more, audit + "K", [*out, (role, text)])
                for name in ("user", "assistant"):
                    go(i + 1, 0, cost + more + 1, audit + "R", [*out, (name, text)])

    go(0, 0, 0, "", [])
    roles = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def _small(rng, n):
    texts = ["a.", "b!", "c", " ", "", "d? \n", "é.", " "]
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]), rng.choice(texts)) for _ in range(n)]


def test_repair_is_the_cheapest_edit(spark):
    rng = random.Random(5)
    convs = [_small(rng, rng.randint(0, 5)) for _ in range(150)]
    rows = [(i, t, r, x) for i, c in enumerate(convs) for t, (r, x) in enumerate(c)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in R.repair(turns).collect()}
    for i, c in enumerate(convs):
        if c:
            r = got[i]
            assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == _plain(c), c
    told = {}
    for r in R.repaired_turns(turns, R.repair(turns)).collect():
        told.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for i, r in got.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(told.get(i, []))).encode()).hexdigest() == r.repaired_sha256


def test_audits_of_blocks_compare_like_strings(monkeypatch):
    rng = random.Random(8)
    convs = [_small(rng, 60) for _ in range(8)]

    def audits():
        out = []
        for c in convs:
            now = R.Conversation()
            for t, (role, text) in enumerate(c):
                now.read(t, role, text + str(t) * (text == "a."))
            out.append(now.row(0))
        return out

    whole = audits()
    for n in (1, 2, 7):
        monkeypatch.setattr(R, "BLOCK", n)
        assert audits() == whole


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = {}
    for r in R.damaged(spark.createDataFrame(rows, TURNS)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.dropped))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [(role, "", True)], 1: [(role, "", False)], 2: [(role, text.replace(".", "").replace("!", ""), False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert got[c, t] == want.get(kind, [(role, text, False)])


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "a."), (None, None, None, None), (1, None, "user", "a."), (1, 5, "assistant", "x" * 100_000 + "."), (1, 5, "assistant", "x" * 100_000 + "."), (2, 9, "user", "b")]
    df = spark.createDataFrame([(*r, "kept?", 7) for r in rows], TURNS + ", audit string, cost long")
    got = {r.conv_id: r for r in R.repair(df).collect()}
    assert got[None].audit == "DD" and got[None].blank == 1
    assert (got[1].audit, got[1].duplicate, got[1].gaps, got[1].cost) == ("KKD", 1, 0, 2)
    assert (got[2].audit, got[2].truncated, got[2].cost, got[2].repaired_sha256) == ("D", 1, 2, hashlib.sha256(b"").hexdigest())
    assert R.repair(R.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_long_conversation_stays_linear():
    import time

    now, began = R.Conversation(), time.time()
    for t in range(60_000):
        now.read(t, ("user", "assistant", "system")[t % 3], f"{t}.")
    assert now.row(1)[7] == 40_000  # the systems go; each costs 2
    assert time.time() - began < 60


def _plain_trie(rows, rebuild=True):
    """The nodes as sorted tuples, from dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = {}
    ends = {}
    for c, turns in own.items():
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 6
            turns = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        value = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += value
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(repr((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], digest(k))) for k, m in members.items())


def _nodes(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("path", [3, 16_384])
def test_trie_equals_dictionaries(spark, monkeypatch, path):
    monkeypatch.setattr(T, "PATH", path)
    rng = random.Random(path)
    rows = []
    for c in [*range(95, 130), 200, 205, 300, 1007, -3, -100, 10**12]:
        rows += [(c, rng.choice([None, t, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é𝒜"])) for t in range(rng.choice([0, 1, 3, 7, 12]))]
    rows += rows[:9] + [(None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", node string")
    assert _nodes(T.prefix_trie(T.rebuilt(df))) == _plain_trie(rows)


def test_trie_of_chains_copies_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 40)
    rows = [(c, t, "user", f"{t if t < c % 7 else (c, t)}") for c in range(60) for t in range(c % 9)]  # combs
    rows += [(c, t, "user", "same") for c in range(1000, 1080) for t in range(3)]  # many ends at one node
    rows += [(5000, t, "user", "long") for t in range(150)]
    df = spark.createDataFrame(rows, TURNS)
    assert _nodes(T.prefix_trie(T.plain(df))) == _plain_trie(rows, rebuild=False)
    assert T.prefix_trie(T.rebuilt(spark.createDataFrame([], TURNS))).collect() == []
