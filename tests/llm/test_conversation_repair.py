"""Conversation repair against a search over all edits, with conversations of any number of blocks."""

import collections
import functools
import hashlib
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dunlin.llm import conversation_repair as cr

STEP = {"": "su", "s": "u", "u": "a", "a": "u"}       # what may follow which last initial


def best_edits(rows):
    """rows of (initial, fault): the cheapest edits and the least audit among them, over every sequence of edits."""
    @functools.lru_cache(None)
    def go(i, last, left):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        if left:
            q = "a" if last == "u" else "u"
            c, w = go(i, q, left - 1)
            found.append((c + 5, "I" + w))
        if i < len(rows):
            initial, fault = rows[i]
            c, w = go(i + 1, last, 2)
            found.append((c + 2, "D" + w))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if initial in STEP[last] and initial:
                    c, w = go(i + 1, initial, 2)
                    found.append((c + extra, "K" + w))
                q = "a" if last == "u" else "u"
                c, w = go(i + 1, q, 2)
                found.append((c + 1 + extra, "R" + w))
        return min(found, default=(10 ** 9, ""))
    return go(0, "", 2)


SPACE = " \t\n\x0b\x0c\r"


def expected(table):
    convs = collections.defaultdict(list)
    for c, t, role, text in table:
        convs[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(x for x in text if x not in ".!?")
        if k == 4:
            role = "user"
        convs[c] += [(t, role, text)] * (2 if k == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, audit = best_edits(tuple(marks)) if marks else (0, "")
        lines, last, i = [], "", 0
        for e in audit:
            if e == "I":
                last = "a" if last == "u" else "u"
                lines.append(("user:", "assistant:")[last == "a"])
                continue
            role, text = rows[i][1:]
            i += 1
            if e == "K":
                last = role[0]
            elif e == "R":
                last = "a" if last == "u" else "u"
                role = ("user", "assistant")[last == "a"]
            if e != "D":
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in rows if r[0] is not None]
        count = collections.Counter(f for _, f in marks)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def write(path, table):
    cols = list(zip(*table)) if table else [[]] * 4
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string()),
                             **{c: pa.array([1] * len(table), pa.int64()) for c in ("place", "n", "codes", "fault", "first", "audit", "state")}}), f"{path}/conversations.parquet")


def odd_conversations(seed=1, convs=120, long_turns=300):
    rng = random.Random(seed)
    table = []
    texts = ["Yes.", "No", "what? ", "é!", "", " \t", None, "a b", "end.\n", "\x1c", "x. ", "Yes.", "tail!" * 30]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "System", "s", "u", "a"]
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            table.append((c if c else None, rng.choice([t, t, t, None, t * 3]), rng.choice(roles if rng.random() < 0.5 else roles[1:3]), rng.choice(texts)))
    for c in (1000, 1001):
        table += [(c, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(roles), f"turn {rng.randint(0, 200)}" + rng.choice([".", "?", "", "!"])) for t in range(long_turns)]
    table += [(2000, 7, "user", "same.")] * 40
    table.append((3000, next(t for t in range(1000) if zlib.crc32(f"3000:{t}".encode()) % 20 == 0), "user", "dropped."))
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("block_rows", [50_000, 40])
def test_op11_against_all_edits(spark, tmp_path, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    table = odd_conversations()
    write(tmp_path, table)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = expected(table)
    assert got.keys() == want.keys() and got[3000][:6] == (0,) * 6
    for c in want:
        assert got[c] == want[c], c


def test_op11_empty(spark, tmp_path):
    write(tmp_path, [])
    assert cr.op11_conversation_repair(spark, str(tmp_path)).collect() == []


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(4)
    solver = cr.Solver()
    for _ in range(1500):
        codes = "".join(chr(65 + rng.choice([0, 1, 2, 1, 2, 1, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 40)))
        rows = tuple((cr.INITIALS[(ord(c) - 65) % 4], ("", "truncated", "blank", "duplicate")[(ord(c) - 65) // 4]) for c in codes)
        cost, audit = best_edits(rows)
        assert solver.whole(codes) == audit and cr.cost_of(codes, audit) == cost
        cuts = sorted({0, len(codes), *(rng.randint(0, len(codes)) for _ in range(4))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        states = solver.chain([solver.matrix(p) for p in parts])
        assert "".join(solver.between(c, p, q) for c, p, q in zip(parts, states, states[1:])) + cr.FINAL[states[-1]][1] == audit


def test_a_long_conversation_takes_linear_space():
    import tracemalloc
    codes = "".join(random.Random(5).choice("BCBCFJ") for _ in range(20_000))
    tracemalloc.start()
    audit = cr.Solver().whole(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(audit.replace("I", "")) == len(codes) and peak < 3_000_000
