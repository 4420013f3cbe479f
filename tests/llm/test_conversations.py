import hashlib
import random
import re
import zlib

import pytest

from ledgermill.llm import conversation_repair, earley
from ledgermill.llm.conversation_repair import as_messages, damage, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int, audit string, part int"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SPACE = "\x20\t\n\x0b\x0c\r"


def spoil(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows, every_id):
    """The contract's columns of each conversation, by a search over the states of a dialogue."""
    found = {}
    for conv_id in every_id:
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults, stood = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in stood else "truncated" if bare[-1] not in ".!?" else "")
            stood.add((role, text))
        states = inserted({0: (0, "", ())})
        for (_, _, role, text), fault in zip(own, faults):
            ways = []
            for state, (cost, audit, done) in states.items():
                ways.append((state, (cost + 4, audit + "D", done)))
                if fault in ("", "truncated"):
                    cost += 3 * (fault == "truncated")
                    if (state, role[:1]) in NEXT:
                        ways.append((NEXT[state, role[:1]], (cost, audit + "K", (*done, f"{role}:{text}"))))
                    ways += [(NEXT[state, x[0]], (cost + 3, audit + "R", (*done, f"{x}:{text}"))) for x in ("user", "assistant") if (state, x[0]) in NEXT]
            states = {}
            for state, way in ways:
                states[state] = min(states.get(state, way), way)
            states = inserted(states)
        cost, audit, done = min(states[s] for s in (0, 3) if s in states)
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv_id] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return found


def inserted(states):
    for _ in range(2):
        for state, (cost, audit, done) in list(states.items()):
            for role in ("user", "assistant"):
                if (to := NEXT.get((state, role[0]))) is not None:
                    way = (cost + 3, audit + "I", (*done, f"{role}:"))
                    states[to] = min(states.get(to, way), way)
    return states


def odd_rows(seed=5, n=120):
    rng = random.Random(seed)
    texts = [None, "", " \n", "Yes.", "No", "What? ", "a.b", "So!\t", "é…", "漢。", "word " * 40_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Server", "us"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    return [(r[0] + 10_000, *r[1:]) for r in given] + odd_rows()


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2) for r in rows], SCHEMA)


def _told(frame):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.select("conv_id", *columns).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in rows}


@pytest.mark.parametrize("long_rows", [10_000, 3, 0])
def test_repairs_are_those_of_a_plain_search(rows, conversations, long_rows):
    """Conversations in memory, some in ranges, and all in ranges."""
    assert _told(repair_conversations(damage(conversations), long_rows=long_rows)) == repaired(spoil(rows), {r[0] for r in rows})


def test_undamaged_rows_and_repaired_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again"), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 5, "assistant", "Hello."), (3, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)
    found = _told(repair_conversations(as_messages(frame)))
    assert found == repaired(rows, {1, 2, 3}) and found[1][6] == "KDK" and found[2][:5] == (4, 0, 0, 0, 1) and found[3][6] == "D"
    told = repair_conversations(as_messages(frame), with_messages=True).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in told] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Yes.", "K"), (2, 0, "system", "Be kind.", "K"), (2, 1, "user", "", "I"), (2, 2, "assistant", "Hello.", "K")]
    again = repair_conversations(as_messages(spark.createDataFrame([(*tuple(r)[:4], 0, "", 0) for r in told if r["conv_id"] != 2], SCHEMA)))
    assert all(r["cost"] == 0 and set(r["audit"]) == {"K"} for r in again.collect())


def test_no_conversations(conversations):
    assert repair_conversations(damage(conversations.where("false"))).count() == 0


def test_a_long_conversation_in_ranges(spark):
    """One conversation holds most rows: no task parses all of it, and the repair is the same."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}."])) for t in range(4000)] + [(8, 0, "user", "A.")]
    frame = as_messages(spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA))
    expected = repaired(rows, {7, 8})
    assert _told(repair_conversations(frame, long_rows=1000)) == expected
    assert _told(repair_conversations(frame, long_chars=5000)) == expected
    pieces = conversation_repair._described(frame).selectExpr("*", "false as seen").select(*conversation_repair._COLUMNS)
    assert conversation_repair._ranges(pieces).select("piece").distinct().count() > 1


def test_blocks_of_any_length(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 333):
        messages = "".join(rng.choice("suaxSUAX-uaua") for _ in range(n))
        results = set()
        for block in (1, 7, 1000):
            monkeypatch.setattr(earley, "BLOCK", block)
            repair = earley.Repair()
            repair.read(messages)
            results.add(repair.result())
            halves = earley.Repair()
            for part in (messages[: n // 3], messages[n // 3 :]):
                halves.join(earley.matrix(part))
            results.add(halves.result())
        assert len(results) == 1
