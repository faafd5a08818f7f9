"""Conversation structure repair: the cheapest edits that make the roles read (system?) (user assistant)*.

The edit lattice of n rows has a node for every number of rows done and every state of the grammar (nothing
yet, after system, user, assistant). Keep, Rerole and Delete go on to the next row, Insert stays; an edit and
a state give the next state, so an audit, the initials of the edits in order, says all. Bidirectional
Dijkstra finds it: a forward and a reverse heap meet, all crossings of the least cost are finished, and of
these the least concatenated audit is taken.

Rows are dealt over tasks by conversation, turn, role and text (range partitioning), so no conversation has to
fit a task. A conversation that lies within a task is repaired at once. Others, the first and last of each task
and those of more than BLOCK rows or BLOCK_BYTES bytes, become blocks: repeated rows are found by grouping; a
block gives the cost and audit from every state to every state; a conversation's blocks, a few numbers each,
are chained; and the chosen audits give each block its repaired rows. An Insert stands before a row, so no
audit of a block begins another one from the same state, and the first difference decides.

Defined results: a null role or text is one space; conversations with a null id are one; rows come by turn,
nulls first, equal turns by role and then by the md5 of the text; an equal role and text is a duplicate wherever
it stood before; rows that are equal throughout are rows of their own, the later ones duplicates; a
conversation without rows is repaired by nothing; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_columns, stored

BLOCK, BLOCK_BYTES = 1024, 4 << 20
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States, the state after an inserted or re-roled turn in each, and the inserts that end a conversation in each.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = ("", "II", "I", "")
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")

_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def _row_steps(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state; 4 more if the row is done) in a state before a row."""
    out = [("D", DELETE, 4 + state), ("I", INSERT, AFTER[state])]
    if letter != "x":
        cut, kept = CUT * letter.isupper(), KEPT.get((state, letter.lower()))
        out.append(("R", REROLE + cut, 4 + AFTER[state]))
        if kept is not None:
            out.append(("K", KEEP + cut, 4 + kept))
    return out


#: letter -> state -> its steps, and (cost, state before) of the steps over a row into it.
STEPS = {x: [_row_steps(x, s) for s in STATES] for x in "xsuaoSUAO"}
BEFORE = {x: [[(cost, s) for s in STATES for _, cost, to in STEPS[x][s] if to == 4 + state] for state in STATES] for x in STEPS}


class Lattice:
    """Nodes 4 * rows done + state, and an end behind those of the last row.

    pattern: a letter per row: x if it has to go, else its role's initial of s, u, a (o: any other), upper case if the
    text is cut; ends: state -> inserts that close it.
    """

    def __init__(self, pattern: str, ends: dict[int, str]):
        self.pattern, self.ends, self.end = pattern, ends, 4 * len(pattern) + 4

    def steps(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, node behind it)."""
        i, state = node >> 2, node & 3
        if i < len(self.pattern):
            return [(edit, cost, 4 * i + to) for edit, cost, to in STEPS[self.pattern[i]][state]]
        if node < self.end and state in self.ends:
            return [(self.ends[state], INSERT * len(self.ends[state]), self.end)]
        return []

    def steps_to(self, node: int) -> list[tuple[int, int]]:
        """(cost, node before)."""
        if node == self.end:
            return [(INSERT * len(tail), self.end - 4 + state) for state, tail in self.ends.items()]
        i, state = node >> 2, node & 3
        found = [(cost, 4 * i - 4 + before) for cost, before in BEFORE[self.pattern[i - 1]][state]] if i else []
        if i < len(self.pattern):
            found += [(INSERT, 4 * i + before) for before in STATES if AFTER[before] == state]
        return found


def cheapest(pattern: str, start: int, ends: dict[int, str]) -> tuple[int, str] | None:
    """(cost, least audit) from a state to any of the ends; None if there is no way."""
    lattice = Lattice(pattern, ends)
    cost, audit, settled = {start: 0}, {start: ""}, set()
    back, back_settled = {lattice.end: 0}, set()
    forward, reverse = [(0, "", start)], [(0, lattice.end)]
    best = None
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            c, said, node = heapq.heappop(forward)
            if node in settled:
                continue
            settled.add(node)
            for edit, more, to in lattice.steps(node):
                key = (c + more, said + edit)
                if to not in cost or key < (cost[to], audit[to]):
                    cost[to], audit[to] = key
                    heapq.heappush(forward, (*key, to))
            met = node
        else:
            c, node = heapq.heappop(reverse)
            if node in back_settled:
                continue
            back_settled.add(node)
            for more, to in lattice.steps_to(node):
                if c + more < back.get(to, c + more + 1):
                    back[to] = c + more
                    heapq.heappush(reverse, (c + more, to))
            met = node
        for to in (met, *(x[2] for x in lattice.steps(met)), *(x[1] for x in lattice.steps_to(met))):
            if to in cost and to in back and (best is None or cost[to] + back[to] < best):
                best = cost[to] + back[to]
    if best is None:
        return None
    # every cheapest way leaves what is settled ahead of `reach` by one step into what is settled behind it
    reach = forward[0][0] if forward else best + 1
    found = []
    for node in settled:
        if cost[node] < reach:
            if node == lattice.end and cost[node] == best:
                found.append(audit[node])
            for edit, more, to in lattice.steps(node):
                if cost[node] + more >= reach and cost[node] + more + back.get(to, best + 1) == best:
                    found.append(audit[node] + edit + _rest(lattice, to, back))
    return best, min(found)


def _rest(lattice: Lattice, node: int, back: dict[int, int]) -> str:
    """The least audit of the cheapest ways from a node to the end."""
    out = []
    while node != lattice.end:
        edit, _, node = min((e, c, to) for e, c, to in lattice.steps(node) if to in back and back[to] + c == back[node])
        out.append(edit)
    return "".join(out)


@functools.lru_cache(50_000)
def repair_whole(pattern: str) -> tuple[int, str]:
    return cheapest(pattern, START, dict(enumerate(TAIL)))


def repair_block(pattern: str) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, audit) of all ways through a block."""
    return [(a, b, *way) for a in STATES for b in STATES if (way := cheapest(pattern, a, {b: ""})) is not None]


def apply_audit(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[dict]:
    """The repaired turns."""
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            if edit == "K":
                state, role = KEPT[state, roles[i][:1]], roles[i]
            else:
                state = AFTER[state]
                role = ROLE[state]
            out.append({"role": role, "text": "" if edit == "I" else texts[i]})
        i += edit != "I"
    return out


def pattern_of(roles: list[str], texts: list[str], repeated) -> tuple[str, dict]:
    """(pattern, counts of the faults): each row's first fault of blank, repeated, cut."""
    out, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        last = _LAST.search(text)
        fault = "blank" if last is None else "duplicate" if repeated(i, role, text) else "truncated" if last[1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
    return "".join(out), counts


def spread(turns: list[int | None]) -> dict:
    known = [t for t in turns if t is not None]
    return {"first_turn": min(known, default=None), "last_turn": max(known, default=None), "turns": len(set(known))}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))  # noqa: B905


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "array<struct<role:string,text:string>>"
RAW = "turns array<long>, roles array<string>, texts array<string>"
SEGMENTS = f"conv_id long, segment long, whole boolean, {COUNTS}, repaired {TURNS}"
STATS = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in re.sub(r"<[^ ]*>", "", ddl).split(", ")]


def _column_wise(rows: list[dict], ddl: str) -> dict:
    return {c: [r.get(c) for r in rows] for c in _names(ddl)}


def _conversations(batches: Iterator[dict], block: int, block_bytes: int) -> Iterator[tuple[int | None, bool, list[tuple]]]:
    """(conv_id, whether all its rows are here, rows) of the runs of equal ids in a sorted partition, cut into blocks."""
    rows: list[tuple] = []
    current, edge, size = None, True, 0
    for batch in batches:
        for conv, turn, role, text, there in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "there")), strict=True):
            if rows and (conv != current or len(rows) >= block or size >= block_bytes):
                cut = conv == current
                yield current, not (edge or cut), rows
                # blocks of one run are parts of it, and so is the rest of a run that was cut
                edge, rows, size = cut, [], 0
            current = conv
            rows.append((turn, role, text) if there else ())
            size += len(text)
    if rows:
        yield current, False, rows


def _first_pass(batches: Iterator[dict], block: int, block_bytes: int) -> Iterator[dict]:
    """Repair what is whole; blocks of the rest go on with their rows."""
    part, out, size = TaskContext.get().partitionId(), [], 0
    for number, (conv, whole, rows) in enumerate(_conversations(batches, block, block_bytes)):
        turns, roles, texts = (list(x) for x in zip(*filter(None, rows))) if any(rows) else ([], [], [])  # noqa: B905
        row = {"conv_id": conv, "segment": (part << 33) + number, "whole": whole}
        if whole:
            seen: set = set()
            pattern, counts = pattern_of(roles, texts, lambda i, *x, seen=seen: x in seen or seen.add(x))
            cost, audit = repair_whole(pattern)
            of = spread(turns)
            gaps = of["last_turn"] - of["first_turn"] + 1 - of["turns"] if of["turns"] else 0
            row |= counts | {"gaps": gaps, "illegal": illegal_pairs([r[:1] for r in roles]), "cost": cost, "audit": audit, "repaired": apply_audit(audit, roles, texts)}
        else:
            row |= {"turns": turns, "roles": roles, "texts": texts}
        out.append(row)
        size += sum(map(len, texts)) + 100
        if size > 4 << 20:
            yield _column_wise(out, f"{SEGMENTS}, {RAW}")
            out, size = [], 0
    yield _column_wise(out, f"{SEGMENTS}, {RAW}")


def _block_ways(batches: Iterator[dict]) -> Iterator[dict]:
    """Per block its counts and all its ways; rank: place of an audit among those from the same state."""
    for batch in batches:
        out = []
        for conv, segment, turns, roles, texts, fresh in zip(*(batch[c] for c in ("conv_id", "segment", "turns", "roles", "texts", "fresh")), strict=True):
            first = set(fresh or ())
            pattern, counts = pattern_of(roles, texts, lambda i, *_, first=first: i not in first)
            ways, ranks = repair_block(pattern), {}
            for a in STATES:
                ranks |= {(a, b): k for k, (_, b) in enumerate(sorted((x[3], x[1]) for x in ways if x[0] == a))}
            initials = [r[:1] for r in roles]
            out.append(
                {"conv_id": conv, "segment": segment, "roles": roles, "texts": texts, "illegal": illegal_pairs(initials), "first": initials[0] if initials else None, "last": initials[-1] if initials else None}
                | spread(turns) | counts | {"ways": [{"a": a, "b": b, "cost": c, "rank": ranks[a, b], "audit": audit} for a, b, c, audit in ways]}
            )
        yield _column_wise(out, BLOCKS)


BLOCKS = f"conv_id long, segment long, {STATS}, roles array<string>, texts array<string>, ways array<struct<a:int,b:int,cost:long,rank:int,audit:string>>"
CHAIN = f"conv_id long, segments array<long>, befores array<int>, behinds array<int>, {COUNTS}"


def chain_blocks(blocks: list[dict]) -> dict:
    """The states between the blocks of a conversation on its cheapest way of least audit, and its counts."""
    togo = [[INSERT * len(t) for t in TAIL]]
    for block in reversed(blocks):
        ahead = togo[-1]
        togo.append([min((w["cost"] + ahead[w["b"]] for w in block["ways"] if w["a"] == a), default=1 << 60) for a in STATES])
    togo.reverse()
    state, befores, behinds = START, [], []
    for k, block in enumerate(blocks):
        way = min((w for w in block["ways"] if w["a"] == state and w["cost"] + togo[k + 1][w["b"]] == togo[k][state]), key=lambda w: w["rank"])
        befores.append(state)
        state = way["b"]
        behinds.append(state)
    turns, first, last, illegal, initial = 0, None, None, 0, None
    for b in blocks:
        if b["turns"]:
            turns += b["turns"] - (b["first_turn"] == last)
            first, last = b["first_turn"] if first is None else first, b["last_turn"]
        illegal += b["illegal"]
        if b["first"] is not None:
            illegal += initial is not None and initial + b["first"] not in LEGAL
            initial = b["last"]
    sums = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")}
    return sums | {
        "segments": [b["segment"] for b in blocks], "befores": befores, "behinds": behinds, "illegal": illegal, "cost": togo[0][START],
        "gaps": last - first + 1 - turns if turns else 0, "audit": TAIL[state],
    }


def _chains(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield _column_wise([{"conv_id": conv} | chain_blocks(blocks) for conv, blocks in zip(batch["conv_id"], batch["blocks"], strict=True)], CHAIN)


def _repair_blocks(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out = []
        for k in range(len(batch["segment"])):
            r = {c: batch[c][k] for c in batch}
            turns = apply_audit(r["piece"] + r["audit"], r["roles"], r["texts"], r["before"])
            out.append({c: r.get(c) for c in _names(SEGMENTS)} | {"whole": False, "audit": r["piece"] + r["audit"], "repaired": turns})
        yield _column_wise(out, SEGMENTS)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Segments of repaired conversations: conv_id, segment, whole, the counts of faults and the cost, audit, repaired (role, text).

    A conversation is one segment, or (whole is false) several in order of `segment`, with its counts and cost in the first one.
    there: a boolean column, false for rows that only name their conversation.
    """
    own = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"),
    ).withColumn("digest", F.md5("text"))
    # equal rows may go to any task, so no row is too frequent
    dealt = own.withColumn("n", F.monotonically_increasing_id() % 1024).repartitionByRange("conv_id", "turn", "role", "digest", "n").sortWithinPartitions("conv_id", "turn", "role", "digest")
    first = stored(map_columns(dealt.select("conv_id", "turn", "role", "text", "there"), lambda batches: _first_pass(batches, block, block_bytes), f"{SEGMENTS}, {RAW}"), "conversations")
    whole, parts = first.where("whole").drop(*_names(RAW)), first.where("NOT whole")

    at = parts.select("conv_id", "segment", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "x"))
    seen = at.groupBy("conv_id", F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2")).agg(F.min(F.struct("segment", "pos")).alias("at"))
    fresh = seen.groupBy(F.col("at.segment").alias("segment")).agg(F.collect_list("at.pos").alias("fresh"))
    blocks = stored(map_columns(parts.select("conv_id", "segment", *_names(RAW)).join(fresh, "segment", "left"), _block_ways, BLOCKS), "conversation-blocks")
    numbers = F.struct("segment", *_names(STATS), F.transform("ways", lambda w: w.dropFields("audit")).alias("ways"))
    chains = stored(map_columns(blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(numbers)).alias("blocks")), _chains, CHAIN), "conversation-chains")
    totals = [c for c in _names(COUNTS) if c != "audit"]
    last = F.size("segments") - 1
    link = chains.select("audit", *totals, last.alias("last"), F.posexplode(F.arrays_zip("segments", "befores", "behinds")).alias("k", "x")).select(
        F.col("x.segments").alias("segment"), F.col("x.befores").alias("before"), F.col("x.behinds").alias("behind"),
        F.when(F.col("k") == F.col("last"), F.col("audit")).otherwise("").alias("audit"), *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in totals],
    )
    own_way = F.filter("ways", lambda w: (w["a"] == F.col("before")) & (w["b"] == F.col("behind")))[0]["audit"]
    joined = blocks.select("conv_id", "segment", "roles", "texts", "ways").join(link, "segment").withColumn("piece", own_way).drop("ways")
    return whole.unionByName(map_columns(joined, _repair_blocks, SEGMENTS))


def _joined(batches: Iterator[dict]) -> Iterator[dict]:
    """Sorted segments -> conversations; the digest goes along as the rows pass."""
    current: dict | None = None
    schema = f"conv_id long, {COUNTS}, repaired_sha256 string"

    def done() -> dict:
        return _column_wise([current | {"audit": "".join(current["audit"]), "repaired_sha256": current["digest"].hexdigest()}], schema)

    for batch in batches:
        for k, conv in enumerate(batch["conv_id"]):
            if current is None or conv != current["conv_id"]:
                if current is not None:
                    yield done()
                current = {c: batch[c][k] for c in _names(COUNTS)} | {"conv_id": conv, "audit": [], "digest": hashlib.sha256(), "any": False}
            current["audit"].append(batch["audit"][k])
            for turn in batch["repaired"][k]:
                current["digest"].update((("\n" if current["any"] else "") + f"{turn['role']}:{turn['text']}").encode())
                current["any"] = True
    if current is not None:
        yield done()


def repair_report(segments: DataFrame) -> DataFrame:
    """Per conversation: conv_id, the counts, cost, audit and the sha256 of its repaired rows as role:text, one to a line.

    A digest has to read a conversation's repaired rows one after another; segments pass through a task, none is kept.
    """
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = segments.where("whole").select("conv_id", *_names(COUNTS), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    ordered = segments.where("NOT whole").select("conv_id", "segment", *_names(COUNTS), "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.unionByName(map_columns(ordered, _joined, f"conv_id long, {COUNTS}, repaired_sha256 string"))


def damage(rows: DataFrame) -> DataFrame:
    """A twentieth of the rows (by a hash of conversation and turn) each: dropped (there is false), emptied, without its ends of sentences, twice, said by the user."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    draw = (F.crc32(named.cast("binary")) % 20).alias("draw")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return rows.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (draw != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


#: DuckDB SQL of repair_report(repair_conversations(damage(conversations))): CRC-32 bit by bit, then the cheapest audit to every state, row by row.
SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS draw FROM {conversations}
), hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt
), faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), inserts(a, b, ins) AS (
  VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')
), kept(b, initial, behind) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
  SELECT a, initial, behind, ins || 'K' AS edits, 2 * length(ins) AS price, true AS stays FROM inserts JOIN kept USING (b)
  UNION ALL SELECT a, NULL, CASE b WHEN 2 THEN 3 ELSE 2 END, ins || 'R', 2 * length(ins) + 2, true FROM inserts
  UNION ALL SELECT a, NULL, b, ins || 'D', 2 * length(ins) + 3, false FROM inserts
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, struct_pack(cost := 0::BIGINT, audit := '') AS best FROM counts
  UNION ALL
  SELECT w.conv_id, f.i, m.behind, min(struct_pack(cost := w.best.cost + m.price + CASE WHEN m.stays AND f.fault = 'truncated' THEN 1 ELSE 0 END, audit := w.best.audit || m.edits))
  FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN moves m ON m.a = w.state AND (m.initial IS NULL OR m.initial = f.initial) AND (NOT m.stays OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, f.i, m.behind
), tails(state, tail) AS (
  VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')
), repaired AS (
  SELECT c.*, w.cost, w.audit FROM counts c JOIN (
    SELECT conv_id, i, min(struct_pack(cost := best.cost + 2 * length(tail), audit := best.audit || tail)) AS t FROM walk JOIN tails USING (state) GROUP BY conv_id, i
  ) x ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.i = c.n, LATERAL (SELECT x.t.cost AS cost, x.t.audit AS audit) w
), edits AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS edit FROM repaired WHERE audit <> ''
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS e FROM edits
), turns AS (
  SELECT p.*, f.role, f.text, max(CASE WHEN p.e = 1 AND p.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS body FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(r.gaps, 0) AS gaps, coalesce(r.blank, 0) AS blank, coalesce(r.duplicate, 0) AS duplicate, coalesce(r.truncated, 0) AS truncated, coalesce(r.illegal, 0) AS illegal,
  coalesce(r.cost, 0) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM named) o LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
