import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lodestar.llm import conversations as c

SPACE = "\x20\t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit, lines) by trying every edit of few turns, two inserts in each gap at most."""
    seen, choices = set(), []
    for role, text in turns:
        last = text.rstrip(SPACE)[-1:]
        gone = not last or (role, text) in seen
        seen.add((role, text))
        cut = last not in (".", "!", "?")
        own = [(3, "D", None)]
        if not gone:
            own += [(cut, "K", (role, text)), (2 + cut, "R", ("user", text)), (2 + cut, "R", ("assistant", text))]
        choices.append(own)
    inserts = [[(2 * n, "I" * n, w) for n in range(3) for w in itertools.product(("user", "assistant"), repeat=n)]] * (len(turns) + 1)
    best = None
    for gaps in itertools.product(*inserts):
        for edits in itertools.product(*choices):
            lines = [(r, "") for r in gaps[0][2]]
            for (_, _, kept), (_, _, more) in zip(edits, gaps[1:], strict=True):
                lines += [kept] if kept else []
                lines += [(r, "") for r in more]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
                audit = gaps[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, gaps[1:], strict=True))
                got = sum(x[0] for x in gaps) + sum(x[0] for x in edits), audit, lines
                best = min(best, got) if best else got
    return best


def settle(turns):
    """The same by the operator's two walks."""
    seen, faults = set(), []
    for t in turns:
        own = c._own_fault(t[1])
        faults.append(c.DUPLICATE if own != c.BLANK and t in seen else own)
        seen.add(t)
    initials = "".join(r[:1] or "\0" for r, _ in turns)
    value = c.backward(initials, faults, c.with_inserts(c.LAST))
    audit, _ = c.forward(initials, faults, value, c.START, True)
    return value[0][c.START], audit, [(r, t) for _, r, t in c.rewritten(audit, c.START, [r for r, _ in turns], [t for _, t in turns])]


def test_every_short_conversation_is_repaired_at_least_cost():
    pick = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool"], ["a.", "b", "", "c! \n"]
    tries = [tuple((r, f"{i}{'.?'[i % 2]}") for i, r in enumerate(w)) for n in range(3) for w in itertools.product(roles, repeat=n)]
    tries += [tuple((pick.choice(roles), pick.choice(texts)) for _ in range(n)) for n, times in ((2, 60), (3, 25)) for _ in range(times)]
    for turns in tries:
        assert settle(turns) == cheapest(turns), turns


def expected(rows):
    """What repaired() has to give, conversation by conversation, in one process."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fault, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        mine = groups.setdefault(conv, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        cost, audit, lines = settle([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        seen, faults = set(), []
        for _, role, text in turns:
            last = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [(a[1][:1] + b[1][:1]) for a, b in itertools.pairwise(turns)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, gaps long, audit string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd():
    pick = random.Random(5)
    rows = [(pick.choice([None, 1, 2, 3, 7]), pick.choice([None, 0, 1, 2, 5, 9]), pick.choice(["user", "assistant", "system", "tool", "", None]), pick.choice([None, "", " \n", "Yes.", "no", "ä?\t", "long. " * 3000])) for _ in range(90)]
    return rows + [(40 + i, 0, "user", "Only one.") for i in range(60)] + [(i, t, "user" if t % 2 == 0 else "assistant", f"Fine {t}.") for i in range(200, 230) for t in range(6)]


@pytest.mark.parametrize("block_turns", [c.BLOCK_TURNS, 4, 1])
def test_odd_conversations(spark, odd, block_turns):
    got = found(c.repaired(c.damaged(frame(spark, odd)), block_turns))
    want = expected(odd)
    assert set(got) == set(want) and any(c.hashlib.sha256().hexdigest() == v[-1] and v[-2] == "" for v in want.values())
    for conv, row in want.items():
        assert got[conv] == row, conv


def test_one_long_conversation_is_dealt_over_blocks_and_parts(spark):
    pick = random.Random(8)
    rows = [(5, t // 2, pick.choice(["user", "assistant", "system"]), f"{pick.randrange(900)}{pick.choice('.!x')}") for t in range(6000)] + [(6, 0, "user", "Hi.")]
    blocks = c._blocks(c.damaged(frame(spark, rows)).where("not gone"), 64)
    sizes = [len(r.faults) for r in blocks.select("faults").collect()]
    assert max(sizes) <= 64 and blocks.select("part").distinct().count() > 4
    assert found(c.repaired(c.damaged(frame(spark, rows)), 64)) == expected(rows)
    turns = c.rebuilt(c.damaged(frame(spark, rows)), 64).where("conv_id = 5").orderBy("part", "block", "place").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == expected(rows)[5][-1]


def test_sql_agrees_on_odd_rows_and_the_whole_table(sf, odd):
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd)
        assert {r[0]: tuple(r[1:]) for r in con.execute(c.repaired_sql()).fetchall()} == expected(odd)
        con.execute(f"CREATE OR REPLACE TABLE conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
        assert {r[0]: tuple(r[1:]) for r in con.execute(c.repaired_sql()).fetchall()} == expected(rows)


def test_empty_table_and_whole_table(spark, sf):
    assert c.repaired(c.damaged(frame(spark, []))).collect() == []
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(c.repaired(c.damaged(rows))) == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
