"""Conversation repair against a plain dynamic program, whole and cut into segments."""

import hashlib
import random
import re
import zlib

import pytest
from brassledger.llm import repair
from brassledger.llm.common import materialize
from brassledger.llm.queries import ORACLE_SQL, QUERIES
from conftest import rows_of

SCHEMA = "conv_id long, turn long, role string, text string, ck string, pos string, audit int, harm int, kind int"


def table(spark, rows):
    return materialize(spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA).repartition(3), "test-rows")


def least(codes):
    """(cost, audit): the least edits, by all suffixes and states."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    best = {"": (0, ""), "a": (0, ""), "s": (10**9, ""), "u": (10**9, "")}
    for code in [None, *reversed(codes)]:
        if code:
            initial, fault = code
            new = {}
            for state in follow:
                found = [(best[state][0] + 4, "D" + best[state][1])]
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    if initial in follow[state]:
                        found.append((best[initial][0] + extra, "K" + best[initial][1]))
                    cost, edits = best["a" if state == "u" else "u"]
                    found.append((cost + 3 + extra, "R" + edits))
                new[state] = min(found)
            best = new
        for _ in range(4):
            best = {q: min(b, (best["a" if q == "u" else "u"][0] + 3, "I" + best["a" if q == "u" else "u"][1])) for q, b in best.items()}
    return best[""]


def repaired(rows, audit):
    out, at, state = [], 0, ""
    for e in audit:
        to = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((to, ""))
        else:
            role, text = rows[at]
            at += 1
            if e != "D":
                out.append((role if e == "K" else to, text))
        state = out[-1][0][0] if out else ""
    return out


def naive(rows):
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(key.encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            role = "user" if harm == 4 else role
            convs[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    return {c: judged(r) for c, r in convs.items()}


def judged(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
    cost, audit = least(tuple(codes))
    turns = {t for t, *_ in rows if t is not None}
    lines = "\n".join(f"{r}:{t}" for r, t in repaired([r[1:] for r in rows], audit))
    n = lambda f: sum(c[1] == f for c in codes)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def invented(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "Anna"]
    texts = ["A b.", "A b", "", " \n\x0b", "Yes!", "No? ", "Ü.", "😀", None, "x" * 70 + "a.", "x" * 70 + "b."]
    return [(rng.choice([*range(12), None]), rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_equals_sql(spark, sf_dir, duck):
    have = QUERIES["op13_repair"](spark, sf_dir).toPandas()
    assert rows_of(have) == rows_of(duck.sql(ORACLE_SQL["op13_repair"]).df())


@pytest.mark.parametrize("segment_rows", [1 << 16, 4, 1])
def test_equals_plain(spark, segment_rows):
    rows = invented(segment_rows, 400)
    rows += [(77, 9223372036854775807, "user", "Hi."), (77, -9223372036854775808, "assistant", "Ho.")] + [(78, 1, "user", "long " * 40000)]
    df = table(spark, rows)
    want = naive(rows)
    want = {c: (min(w[0], 2**63 - 1), *w[1:]) for c, w in want.items()}
    assert got(repair.report(repair.damaged(df), df.select("conv_id"), segment_rows)) == want


def test_walk_is_least():
    rng = random.Random(1)
    for n in [*range(9)] * 40 + [60, 200]:
        codes = [(rng.randrange(4), rng.randrange(4)) for _ in range(n)]
        letters = "".join(repair.code(*c) for c in codes)
        want = least(tuple(("sua?"[i], repair.FAULTS[f]) for i, f in codes))
        cost, audit, state = repair.walk(letters, repair.END, repair.START, True)
        assert (cost, audit) == want and state in (repair.START, repair.ASSISTANT)
        # The matrix gives the same cost, and a walk in two parts the same edits.
        assert repair.through(repair.matrix(letters), repair.END)[repair.START] == cost
        middle = repair.through(repair.matrix(letters[n // 2 :]), repair.END)
        _, first, state = repair.walk(letters[: n // 2], middle, repair.START, False)
        assert first + repair.walk(letters[n // 2 :], repair.END, state, True)[1] == audit


@pytest.mark.parametrize("segment_rows", [1 << 16, 3])
def test_repaired_rows(spark, segment_rows):
    """Any table can be repaired as it is; the rows' roles are legal."""
    rows = invented(9, 300)
    out = repair.Repair(table(spark, rows).select("conv_id", "turn", "role", "text"), segment_rows).repaired().collect()
    convs = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.pos, r.at)):
        convs.setdefault(r.conv_id, []).append(r)
    want = {c: judged([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c]) for c, *_ in rows}
    for c, w in want.items():
        mine = convs.get(c, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == w[-1]
        assert "".join(r.edit for r in mine) == w[-2].replace("D", "")


def test_one_conversation_and_none(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"Row {t % 50}.") for t in range(3000)]
    df = table(spark, rows)
    assert got(repair.report(repair.damaged(df), df.select("conv_id"), 256)) == naive(rows)
    none = table(spark, [])
    assert repair.report(repair.damaged(none), none.select("conv_id")).count() == 0
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:1]
    df = table(spark, gone)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(repair.report(repair.damaged(df), df.select("conv_id"))) == {gone[0][0]: (0, 0, 0, 0, 0, 0, "", nothing)}
