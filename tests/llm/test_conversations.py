"""Operator 11: the repair against a search that carries whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from fluxbook.llm.conversations import OP11_SQL, damage_conversations, op11_repair_conversations, repair_conversations, repair_digests

ROWS = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def repaired(rows):
    """Faults, cost, audit and digest of the rows of one conversation, all edit strings of each state of the grammar compared."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {"": (0, "", ())}  # the last kept initial tells what may follow; "s" is first if it is last

    def offer(into, kept, initial, entry):
        whole = {"": "", "s": "s", "u": "u", "a": "ua"}[kept] + initial
        if re.fullmatch("(s?(ua)*u?)?", whole) and entry[:2] < into.get(whole[-1:], (1 << 60,))[:2]:
            into[whole[-1:]] = entry

    def with_inserts(found):
        found = dict(found)
        for _ in range(2):
            for kept, (cost, audit, made) in list(found.items()):
                for role in ("user", "assistant"):
                    offer(found, kept, role[0], (cost + 3, audit + "I", made + (f"{role}:",)))
        return found

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        ways = [(kept, *entry) for kept, entry in with_inserts(best).items()] + [(kept, *entry) for kept, entry in best.items()]
        for kept, cost, audit, made in ways:
            offer(after, kept, "", (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            offer(after, kept, role[:1] or "?", (cost + more, audit + "K", made + (f"{role}:{text}",)))
            for new in ("user", "assistant"):
                offer(after, kept, new[0], (cost + 3 + more, audit + "R", made + (f"{new}:{text}",)))
        best = after
    cost, audit, made = min((e for kept, e in with_inserts(best).items() if kept in ("", "a")), key=lambda e: e[:2])
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def wanted(rows, hurt):
    by = {r[0]: [] for r in rows}
    for row in hurt:
        by[row[0]].append(row)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: repaired(own) if own else empty for conv, own in by.items()}


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "user" if turn % 2 == 0 else "assistant"], [3, 3, 1, 1, 1, 1, 12])[0]
            text = rng.choices([f"w{rng.randint(0, 9)}.", f"x{conv} {turn}?", f"open {rng.random()}", " ", None, "", "é . \t"], [3, 12, 3, 1, 1, 1, 1])[0]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(11)
    rows = random_rows(rng, 60, 9) + [(100 + c, t, r, x) for c, t, r, x in random_rows(rng, 4, 300)]
    rows += [rows[3]] * 3 + [(None, 1, "user", "a."), (None, 2, "user", "b."), (None, None, None, None), (900, None, "user", "x."), (901, 5, "assistant", "y")]
    return rows


def test_against_search(frame, hard_rows, folder):
    import pyarrow as pa

    names = ("conv_id", "turn", "role", "text")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    path = folder(conversations=pa.table({n: pa.array([r[i] for r in hard_rows], t) for i, (n, t) in enumerate(zip(names, types))}))
    query = op11_repair_conversations(frame([], ROWS).sparkSession, path)
    assert found(query) == wanted(hard_rows, damaged(hard_rows))
    assert compare(query, connect(path), OP11_SQL) is None


@pytest.mark.parametrize("run,fan", [(1, 2), (4, 3), (7, 2)])
def test_runs_of_any_size(frame, hard_rows, run, fan):
    """Long conversations cut into many runs and levels of runs give the same edits."""
    edits, report = repair_conversations(frame(hard_rows, ROWS), run=run, fan=fan)
    got = found(report.join(repair_digests(edits), "key").withColumn("conv_id", F.when(F.col("key") != "\x00", F.col("key")).cast("long")))
    space = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in hard_rows]
    assert got == wanted(space, space)


def test_edits_give_allowed_roles(frame, hard_rows):
    edits, _ = repair_conversations(frame(hard_rows, ROWS))
    kept = {}
    for r in edits.filter("edit <> 'D'").orderBy("key", "place", "step").collect():
        kept.setdefault(r["key"], []).append(r["role"][0])
    assert all(FORM.fullmatch("".join(roles)) for roles in kept.values()) and len(kept) > 30


def test_edges(frame):
    edits, report = repair_conversations(frame([], ROWS))
    assert edits.collect() == [] and report.collect() == []
    assert damage_conversations(frame([], ROWS)).collect() == []
    rows = frame([(1, 0, "user", "a.", 9, "k")] * 3 + [(1, 1, "assistant", "b.", 9, "k")], f"{ROWS}, place long, key string")
    edits, report = repair_conversations(rows)
    assert [r["audit"] for r in repair_digests(edits).collect()] == ["KDDK"]
    assert [(r["duplicate"], r["illegal"], r["cost"]) for r in report.collect()] == [(2, 2, 8)]
    long = frame([(1, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + f"{t}.") for t in range(4)], ROWS)
    assert [r["audit"] for r in repair_digests(repair_conversations(long)[0]).collect()] == ["KKKK"]
