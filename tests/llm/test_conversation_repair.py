"""Conversation repair against all edit sequences, and against whole strings kept per state."""

import hashlib
import itertools
import random
import zlib

import pytest

from conftest import DATA
from tabflow.llm import conversation_repair as cr
from tabflow.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(WHITE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def by_all_edits(rows):
    """Every sequence of edits with up to two turns put in at a place."""
    faults, best = faults_of(rows), None
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, _), fault in zip(rows, faults):
        choices.append(inserts)
        more = 5 if fault == "truncated" else 0
        kept = [] if fault in ("blank", "duplicate") else [("K", role[:1] or "?", more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        choices.append([("D", "", 2), *kept])
    for picked in itertools.product(*choices, inserts):
        cost, audit, initials = 0, "", ""
        for x in picked:
            if isinstance(x, str):
                cost, audit, initials = cost + 5 * len(x), audit + "I" * len(x), initials + x
            else:
                cost, audit, initials = cost + x[2], audit + x[0], initials + (x[1] or "")
        if legal(initials) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def by_strings(rows):
    """The cheapest edits by keeping the whole audit of each state."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "")}

    def take(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found
            return True

    def put_in():
        while any(
            take(best, b, (best[a][0] + 5, best[a][1] + "I"))
            for (a, initial), b in after.items()
            if initial != "s" and a in best
        ):
            pass

    for (_, role, _), fault in zip(rows, faults_of(rows)):
        put_in()
        new = {}
        for state, (cost, audit) in best.items():
            take(new, state, (cost + 2, audit + "D"))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                for (a, initial), b in after.items():
                    if a == state and initial == role[:1]:
                        take(new, b, (cost + more, audit + "K"))
                    if a == state and initial != "s":
                        take(new, b, (cost + more + 1, audit + "R"))
        best = new
    put_in()
    return min(best[k] for k in (0, 3) if k in best)


def applied(rows, audit):
    out, at, before = [], 0, ""
    for edit in audit:
        want = "a" if before == "u" else "u"
        if edit == "I":
            out.append(({"u": "user", "a": "assistant"}[want], ""))
        else:
            role, text = rows[at][1:]
            at += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[want], text))
        before = out[-1][0][:1]
    return out


def expected(rows):
    """Of one conversation's rows (turn, role, text): what the operator returns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, turns = faults_of(rows), {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit = by_strings(rows)
    text = "\n".join(f"{a}:{b}" for a, b in applied(rows, audit))
    counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_rows(r, n, first=0):
    texts = ["Yes.", "No!", "and so", "", " \n", "Why?", "x ", "Fine. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "sales", ""]
    return [(first + k, r.choice(roles), r.choice([*texts, f"No {k}.", f"No {k}."])) for k in range(n)]


def test_cheapest_edits_by_all_sequences():
    r = random.Random(1)
    for _ in range(60):
        rows = some_rows(r, r.randint(0, 3))
        assert by_all_edits(rows) == by_strings(rows)


def test_paths_by_whole_strings():
    """Also in blocks that are solved from each state and put together."""
    r = random.Random(2)
    for n in [*range(40), 300, 900]:
        rows = some_rows(r, n)
        steps = [(role[:1], fault, 1) for (_, role, _), fault in zip(rows, faults_of(rows))]
        want = by_strings(rows)
        shared, paths = cr.solve(steps, cr.START)
        cost, nodes = paths.finish()
        assert (cost, shared + cr.edits_of(nodes)) == want
        paths, audit, at = cr.Paths(cr.START), "", 0
        while at < n:
            size = r.randint(1, 9)
            found = []
            for begin in range(4):
                before, inner = cr.solve(steps[at : at + size], begin)
                for end, (cost, node) in inner.best.items():
                    found.append((begin, end, cost, before + cr.edits_of(inner.rest(node))))
            audit += cr.edits_of(paths.decided())
            paths.block(None, found)
            at += size
        cost, nodes = paths.finish()
        assert (cost, audit + cr.edits_of(nodes)) == want


def test_memory_holds_the_undecided_end_alone():
    """Survivors coalesce: of 20,000 rows only a short end is ever undecided."""
    r, paths, most = random.Random(3), cr.Paths(cr.START), 0
    for k in range(20_000):
        paths.row("ua"[k % 2] if r.random() < 0.9 else r.choice("uas"), r.choice(["", "", "", "blank", "truncated"]), 1)
        paths.decided()
        most = max(most, *(len(paths.rest(node)) for _, node in paths.best.values()))
    assert most < 200


CLASHING = "*, 1 AS id, 2 AS part, 3 AS said, 4 AS copies_, 'x' AS audit, 5 AS seen, 6 AS words"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, a long conversation, a conversation of equal rows."""
    r = random.Random(4)
    rows = [(c, *row) for c in range(40) for row in some_rows(r, r.randint(1, 9), r.randint(-3, 3))]
    rows += [(None, None, None, None), (None, 3, "user", None), (None, 2, None, "Hm."), (50, None, "user", "a.")] * 2
    rows += [(50, None, "assistant", "b."), (50, 1, "user", "tie."), (50, 1, "assistant", "tie."), (50, 1, "user", "tie")]
    rows += [(60, *row) for row in some_rows(r, 1500)]
    rows += [(61, 1, "user", "again.")] * 500 + [(62, k, "user", "again.") for k in range(0, 400, 2)]
    rows += [(63, 1, "user", "word " * 30_000 + "."), (63, 2, "assistant", "End.")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(*CLASHING.split(", "))


def by_conversation(rows):
    out = {}
    for c, *row in rows:
        out.setdefault(c, []).append(tuple(row))
    return out


def check(parts, want):
    names = (*cr.COUNTS, "cost", "audit", "repaired_sha256")
    got = cr.digests(parts).collect()
    assert len(got) == len(want)
    for x in got:
        assert tuple(x[c] for c in names) == want[x.id], x.id


def plain(df):
    return [(x.conv_id, x.turn, *(" " if v is None else v for v in (x.role, x.text))) for x in df.collect()]


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_repair_by_brute_force(odd, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    want = {c: expected(rows) for c, rows in by_conversation(plain(odd)).items()}
    parts = cr.repair(odd)
    check(parts, want)
    if block_rows == 1024:
        whole = {x.id: x for x in parts.where("part IS NULL").collect()}
        rows = by_conversation(plain(odd))
        some = [c for c in whole if c is not None and c < 40]
        assert len(some) > 20
        for c in some:
            ordered = sorted(rows[c], key=lambda r: (r[0], r[1].encode(), r[2].encode()))
            assert [(t.role, t.text) for t in whole[c].turns] == applied(ordered, whole[c].audit)


def test_empty_tables(odd):
    assert cr.digests(cr.repair(odd.limit(0))).count() == 0


def damaged(rows):
    """Each conversation's rows after damage, by the contract's rule."""
    out = {}
    for c, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, turn))
        what = zlib.crc32(key.encode()) % 20
        of = out.setdefault(c, [])
        if what == 0:
            continue
        text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
        of += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def test_query_by_brute_force(spark, odd, tmp_path):
    odd.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (str(tmp_path), str(DATA / "sf0.01")):
        rows = plain(spark.read.parquet(f"{folder}/conversations.parquet"))
        want = {c: expected(x) for c, x in damaged(rows).items()}
        got = {x.conv_id: x for x in QUERIES["op11_conversation_repair"](spark, folder).collect()}
        assert got.keys() == want.keys()
        for c, x in got.items():
            names = (*cr.COUNTS, "cost", "audit", "repaired_sha256")
            assert tuple(x[k] for k in names) == want[c], c
