"""Repair of conversations: the cheapest edits that make roles alternate, found by dynamic programming over turns and grammar states.

A conversation's rows come as blocks of at most BLOCK_TURNS turns in order, however long it is.
A block is summed up as the cheapest costs from each state before it to each state
after it.  Going through these sums from the end gives the cost-to-go behind every block, with
which each block is walked forward from each state it may be entered in, taking the edit of the
least letter among those that keep the total cheapest; going through them from the
beginning then says in which state a block is entered.  No step holds the rows of more
than a block, so that neither a conversation nor a partition has to fit anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ARROW_ROWS, arrow_rows, written
from lodestar.session import few

#: Turns and characters of a block; a longer text is a block of its own.
BLOCK_TURNS, BLOCK_CHARS = 1024, 8 << 20
#: What edits cost; a truncated turn that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults, the first of which counts.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
NEVER = 1 << 60

#: The grammar (s?(ua)+)? as states: nothing yet, after s, after u, after a.  NEXT says where a role's initial leads.
START, S, U, A = range(4)
NEXT = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
#: In which state nothing more need follow.
LAST = (0, NEVER, NEVER, 0)
#: The one role that a turn of any state can be given or inserted with, and where it leads.
ROLE, AFTER = ("user", "user", "assistant", "user"), (U, U, A, U)


def _shown(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone) with the faults of a fixed rule: crc32 of `conv_id:turn` modulo 20.

    0 drops a row (gone is true), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    Nulls are shown as a space, in the rule and as role and text.  Dropped rows stay marked, so that their conversations are known.
    """
    fault = F.crc32(F.concat(_shown(conv_id), F.lit(":"), _shown(turn)).cast("binary")) % 20
    given = rows.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), _shown(role).alias("role"), _shown(text).alias("text"), fault.alias("fault"))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    by = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return given.select("conv_id", "turn", by.alias("role"), said.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


_BLOCK = "conv_id long, part int, block long, turns array<long>, roles array<string>, texts array<string>, faults array<int>, digests array<binary>, initials string, lowest long, highest long"


def _own_fault(text: str) -> int:
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
    return BLANK if not last else FINE if last in ".!?" else CUT


def _blocks(rows: DataFrame, block_turns: int) -> DataFrame:
    """Rows in order (conversation, turn with nulls first, role, text), a row for each run of turns of a conversation in a partition.

    Ranges deal a long conversation over many partitions; a block's place is (part, block).
    A duplicate of a turn of the same block is marked here, one of an earlier block later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[dict] = []
        at: list[int | None] = [None, 0, 0, 0]  # conversation, part, characters, next block

        def block() -> int:
            """Ends a block and returns its characters."""
            digests = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for _, r, t in held]
            faults, seen = [], set()
            for (_, _, t), d in zip(held, digests, strict=True):
                own = _own_fault(t)
                faults.append(DUPLICATE if own != BLANK and d in seen else own)
                seen.add(d)
            known = [t for t, _, _ in held if t is not None]
            out.append({
                "conv_id": at[0], "part": at[1], "block": at[3], "turns": [t for t, _, _ in held], "roles": [r for _, r, _ in held], "texts": [t for _, _, t in held], "faults": faults,
                "digests": digests, "initials": "".join(r[:1] or "\0" for _, r, _ in held), "lowest": min(known, default=None), "highest": max(known, default=None),
            })
            held.clear()
            size, at[2], at[3] = at[2], 0, at[3] + 1
            return size

        first, waiting = True, 0
        for b in batches:
            for conv, turn, role, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (conv != at[0] or len(held) >= block_turns or at[2] + len(text) > BLOCK_CHARS):
                    waiting += block()
                    if waiting > BLOCK_CHARS or len(out) >= ARROW_ROWS:
                        yield _made(out, _BLOCK)
                        waiting = out.clear() or 0
                if first or conv != at[0]:
                    at[3], first = 0, False
                at[:3] = conv, part, at[2] + len(text)
                held.append((turn, role, text))
        if held:
            block()
        if out:
            yield _made(out, _BLOCK)

    shape = rows.sparkSession.sparkContext.defaultParallelism * 4
    start = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    ranged = rows.repartitionByRange(shape, *start, F.substring("text", 1, 32).asc()).sortWithinPartitions(*start, F.col("text").asc())
    return ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(run, _BLOCK)


@lru_cache(4096)
def costs(initial: str, fault: int) -> tuple[tuple[str, int, int, int], ...]:
    """What can be done with a turn: (letter, state before, state after, cost)."""
    cut = TRUNCATED if fault == CUT else 0
    out = [("D", s, s, DELETE) for s in range(4)]
    if fault in (FINE, CUT):
        out += [("K", s, NEXT[s][initial], KEEP + cut) for s in range(4) if initial in NEXT[s]]
        out += [("R", s, AFTER[s], REROLE + cut) for s in range(4)]
    return tuple(out)


def with_inserts(value: list[int]) -> list[int]:
    """Cost-to-go from each state in a gap, of that behind the gap: any number of turns may be inserted."""
    value = list(value)
    for _ in range(3):  # no chain of inserts is longer than the states
        for s in range(4):
            value[s] = min(value[s], INSERT + value[AFTER[s]])
    return value


def backward(initials: str, faults: list[int], behind: list[int]) -> list[list[int]]:
    """Cost-to-go from each state in the gap before each turn of a block; the last is behind, as given."""
    out = [list(behind)]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after, now = out[-1], [NEVER] * 4
        for _, s, to, cost in costs(initial, fault):
            now[s] = min(now[s], cost + after[to])
        out.append(with_inserts(now))
    return out[::-1]


def forward(initials: str, faults: list[int], value: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """(audit, state behind): of the edits that keep to the cheapest cost-to-go always the one of the least letter.

    Inserts before a block's turns belong to it; those behind its last one only if the conversation ends there.
    """
    audit, i = [], 0
    while i < len(initials) or (last and value[i][state]):
        here = value[i][state]
        tight = [("I", i, AFTER[state])] if INSERT + value[i][AFTER[state]] == here else []
        if i < len(initials):
            tight += [(letter, i + 1, to) for letter, s, to, cost in costs(initials[i], faults[i]) if s == state and cost + value[i + 1][to] == here]
        letter, i, state = min(tight)
        audit.append(letter)
    return "".join(audit), state


def rewritten(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of what a block entered in state becomes by audit."""
    turns = zip(roles, texts, strict=True)
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state][role[:1]]
        else:
            role, state = ROLE[state], AFTER[state]
        yield letter, role, text


_SETTLED = _BLOCK + ", audit string, state int, cost long"
_PLACE = ["conv_id", "part", "block"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _made(out: list, names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(","))]))


def _mapped(rows: DataFrame, one: Callable[[dict], dict], schema: str) -> DataFrame:
    """rows with each made another by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _made([one(r) for r in b.to_pylist()], schema)

    return rows.mapInArrow(run, schema)


def _whole(row: dict) -> dict:
    """A conversation of one block, settled at once."""
    value = backward(row["initials"], row["faults"], with_inserts(LAST))
    return row | {"audit": forward(row["initials"], row["faults"], value, START, True)[0], "state": START, "cost": value[0][START]}


def _summed(row: dict) -> dict:
    """A block with what it costs from each state before it to each behind it, 16 numbers."""
    sums = [backward(row["initials"], row["faults"], [0 if s == to else NEVER for s in range(4)])[0] for to in range(4)]
    return {n: row[n] for n in (*_PLACE, "initials", "faults")} | {"sums": [sums[to][s] for s in range(4) for to in range(4)]}


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations, last ones first, with the cost-to-go behind each."""
    at, behind = object(), []
    for b in batches:
        out = []
        for r in b.to_pylist():
            last = r["conv_id"] != at
            at, behind = r["conv_id"], with_inserts(LAST) if last else behind
            out.append({n: r[n] for n in (*_PLACE, "initials", "faults")} | {"behind": behind, "last": int(last)})
            behind = [min(r["sums"][4 * s + to] + behind[to] for to in range(4)) for s in range(4)]
        yield _made(out, _BEHIND)


def _walked(row: dict) -> dict:
    """A block's audits and states behind it for each state that it can be entered in."""
    value = backward(row["initials"], row["faults"], row["behind"])
    walks = [forward(row["initials"], row["faults"], value, s, bool(row["last"])) for s in range(4)]
    return {n: row[n] for n in _PLACE} | {"audits": [a for a, _ in walks], "exits": [s for _, s in walks], "cost": value[0][START]}


def _from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations in order, with the state that each is entered in; the first one's cost is the conversation's."""
    at, state = object(), START
    for b in batches:
        out = []
        for r in b.to_pylist():
            first = r["conv_id"] != at
            at, state = r["conv_id"], START if first else state
            out.append({n: r[n] for n in _PLACE} | {"audit": r["audits"][state], "state": state, "cost": r["cost"] if first else 0})
            state = r["exits"][state]
        yield _made(out, _ENTERED)


_SUMS = "conv_id long, part int, block long, initials string, faults array<int>, sums array<long>"
_BEHIND = "conv_id long, part int, block long, initials string, faults array<int>, behind array<long>, last int"
_WALKS = "conv_id long, part int, block long, audits array<string>, exits array<int>, cost long"
_ENTERED = "conv_id long, part int, block long, audit string, state int, cost long"


def _with_earlier(blocks: DataFrame) -> DataFrame:
    """Blocks whose turns are marked as duplicates of those of earlier blocks, too."""
    place = F.struct("part", "block")
    held = blocks.select(*_PLACE, F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = held.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnsRenamed({"conv_id": "c", "digest": "d"})
    later = held.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(place > F.col("first"))
    again = later.groupBy(*_PLACE).agg(F.collect_set("digest").alias("again")).withColumnsRenamed({n: f"{n}_" for n in _PLACE})  # no more than a block has turns
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in _PLACE]
    marked = F.zip_with("faults", "digests", lambda f, d: F.when((f != BLANK) & F.array_contains("again", d), DUPLICATE).otherwise(f))
    found = blocks.join(again, on[0] & on[1] & on[2], "left")
    return found.withColumn("faults", F.when(F.col("again").isNull(), F.col("faults")).otherwise(marked)).select(*blocks.columns)


def _settle_long(blocks: DataFrame) -> DataFrame:
    """Conversations of several blocks: sums, from the end, walks, from the start."""
    blocks = written(_with_earlier(blocks), "long")

    def ordered(rows: DataFrame, descending: bool) -> DataFrame:
        turn = F.desc if descending else F.asc
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", turn("part"), turn("block"))

    sums = _mapped(blocks.select(*_PLACE, "initials", "faults"), _summed, _SUMS)
    behind = written(ordered(sums, True).mapInArrow(_from_the_end, _BEHIND), "behind")
    walks = _mapped(behind.repartition(max(1, behind.sparkSession.sparkContext.defaultParallelism)), _walked, _WALKS)
    entered = ordered(walks, False).mapInArrow(_from_the_start, _ENTERED).withColumnsRenamed({n: f"{n}_" for n in _PLACE})
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in _PLACE]
    return blocks.join(entered, on[0] & on[1] & on[2]).select(*(c.split()[0] for c in _SETTLED.split(",")))


def settled(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(whole, long): blocks of conversations with faults, audit, the state they are entered in and the cost; whole has those of one block.

    rows: (conv_id, turn, role, text), and gone where a row isn't there any more.
    """
    arrow_rows(rows.sparkSession)
    there = rows.where("not gone") if "gone" in rows.columns else rows
    blocks = written(_blocks(there, block_turns), "blocks")
    long = written(blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c")), "several")
    if not long.head(1):
        return _mapped(blocks, _whole, _SETTLED), _mapped(blocks.limit(0), _whole, _SETTLED)
    on = F.col("conv_id").eqNullSafe(F.col("c"))
    return _mapped(blocks.join(few(long), on, "left_anti"), _whole, _SETTLED), _settle_long(blocks.join(few(long), on, "left_semi"))


class Tally:
    """What a conversation's blocks add up to, taken in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.lines = conv_id, hashlib.sha256(), 0
        self.faults, self.audit, self.cost, self.illegal, self.before = [0] * 4, [], 0, 0, ""
        self.distinct, self.turn, self.lowest, self.highest = 0, None, None, None

    def add(self, block: dict) -> None:
        initials = self.before + block["initials"]
        self.illegal += sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        self.before = initials[-1:]
        for f in block["faults"]:
            self.faults[f] += 1
        for t in block["turns"]:
            if t is not None and t != self.turn:  # turns are in order
                self.distinct, self.turn = self.distinct + 1, t
        if block["lowest"] is not None:
            self.lowest, self.highest = block["lowest"] if self.lowest is None else self.lowest, block["highest"]
        for _, role, text in rewritten(block["audit"], block["state"], block["roles"], block["texts"]):
            self.hash.update((f"{chr(10) * bool(self.lines)}{role}:{text}").encode())
            self.lines += 1
        self.audit.append(block["audit"])
        self.cost += block["cost"]

    def result(self) -> dict:
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.distinct
        named = dict(zip(("blank", "duplicate", "truncated"), self.faults[1:], strict=True))
        return {"conv_id": self.conv_id, "gaps": gaps, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()} | named


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Tally | None = None
    for b in batches:
        out = []
        for i in range(b.num_rows):  # a row may hold a block's texts: one at a time
            row = b.slice(i, 1).to_pylist()[0]
            if now is None or now.conv_id != row["conv_id"]:
                out += [now.result()] if now else []
                now = Tally(row["conv_id"])
            now.add(row)
        yield _made(out, _RESULT)
    if now:
        yield _made([now.result()], _RESULT)


def repaired(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation's cheapest repair.

    rows: (conv_id, turn, role, text), and gone where a row isn't there any more, as damaged() gives
    them.  A conversation's rows go by turn, nulls first, then by role and text.  A missing conv_id
    is a conversation of its own; roles and texts mustn't be null (damaged() shows them as a
    space), and roles may be anything: one whose initial isn't s, u or a can't be kept.  Conversations whose
    rows are all gone have zeros, no edits and the digest of nothing; an empty table gives an
    empty one.  Of a long conversation one task reads the repaired texts in order, for that is what
    its digest asks for, a block at a time; all else is done block by block.
    """
    whole, long = settled(rows, block_turns)
    parts = whole.mapInArrow(_tallied, _RESULT).unionByName(long.repartition("conv_id").sortWithinPartitions(*_PLACE).mapInArrow(_tallied, _RESULT))
    if "gone" not in rows.columns:
        return parts
    zeros = {n: F.lit(0).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    lost = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("all")).where("all").select("conv_id")
    return parts.unionByName(lost.withColumns(zeros))


def rebuilt(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, part, block, place, edit, role, text) of the repaired turns themselves, in the order of part, block and place."""
    whole, long = settled(rows, block_turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            made = [{n: r[n] for n in _PLACE} | {"place": i, "edit": e, "role": role, "text": t} for i, (e, role, t) in enumerate(rewritten(r["audit"], r["state"], r["roles"], r["texts"]))]
            yield _made(made, _TURNS)

    return whole.unionByName(long).mapInArrow(run, _TURNS)


_TURNS = "conv_id long, part int, block long, place int, edit string, role string, text string"


def repaired_sql() -> str:
    """repaired(damaged(conversations)) in DuckDB's dialect: the same costs and edits as strings, from the last turn to the first."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    data = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20"
    best = lambda *found: f"list_min([{', '.join(found)}])"
    made = lambda cost, letter, line, v: f"{{'c': {cost} + {v}.c, 'a': '{letter}' || {v}.a, 'l': {f'list_prepend({line}, {v}.l)' if line else f'{v}.l'}}}"
    stays, cut = "fault IN (0, 3)", "CASE WHEN fault = 3 THEN 1 ELSE 0 END"
    edited = []
    for s in range(4):
        keeps = "".join(f" WHEN {stays} AND left(role, 1) = '{i}' THEN {made(cut, 'K', chr(39) + chr(39) + ' || role || ' + chr(39) + ':' + chr(39) + ' || text', f'v{to}')}" for i, to in NEXT[s].items())
        again = f"CASE WHEN {stays} THEN {made('2 + ' + cut, 'R', f'{chr(39)}{ROLE[s]}:{chr(39)} || text', f'v{AFTER[s]}')} END"
        edited.append(f"{best(made('3', 'D', '', f'v{s}'), f'CASE{keeps} END', again)} AS w{s}")
    insert = lambda s, v: made("2", "I", f"'{ROLE[s]}:'", v)
    end = ", ".join(f"{{'c': {c}::BIGINT, 'a': '{a}', 'l': {lines}::VARCHAR[]}} AS v{s}" for s, (c, a, lines) in enumerate(((0, "", "[]"), (4, "II", "['user:', 'assistant:']"), (2, "I", "['assistant:']"), (0, "", "[]"))))
    return f"""
        WITH RECURSIVE tables AS (SELECT {table} AS t),
        given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS f FROM conversations, tables),
        harmed AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM given),
        placed AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i,
                          right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, lag(left(role, 1)) OVER w || left(role, 1) AS pair
                   FROM harmed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        turns AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
        counted AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
        steps AS (
            SELECT conv_id, n AS i, {end} FROM counted
            UNION ALL
            SELECT conv_id, i - 1, {best("w0", insert(0, "u"))}, {best("w1", insert(1, "u"))}, u, {best("w3", insert(3, "w2"))}
            FROM (SELECT *, {best("w2", insert(2, "w3"))} AS u FROM (
                SELECT s.conv_id, s.i, {", ".join(edited)} FROM steps s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i WHERE s.i > 0)))
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.i = 0"""
