"""Conversation structure repair: damage by a rule, then the cheapest edits that make roles alternate, by Viterbi over four grammar states.

The states are what a conversation has so far: nothing, a system turn, an open user turn, a closed pair. Each holds the least (cost,
audit string) that leads to it; after each turn its layer is closed by inserted turns, two at most, as two lead from any state to any
other that inserts can reach.

A conversation of any length is cut into blocks of bounded size. A block gives, for each state that it may begin in, the least (cost,
audit) for each state that it may end in; blocks are then run through in order with four states again.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

#: States: nothing yet, after the system turn, user turn open, pair closed. What a turn of each role leads to.
STATES, ENDS = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Turns and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 22

Best = tuple[int, str] | None


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to (conv_id, turn, role, text, n), n the number of equal turns after damage.

    A turn that is dropped leaves a row with n = 0, so that its conversation stays known. Equal rows are one row here, before any of
    them moves.
    """
    c = F.col
    key = F.concat(F.coalesce(c("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("d"))
    gone = c("d") == 0
    text = F.when(gone | (c("d") == 1), "").when(c("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text"))
    role = F.when(gone, "").when(c("d") == 4, "user").otherwise(c("role"))
    rows = rows.select("conv_id", F.when(~gone, c("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(gone, 0).when(c("d") == 3, 2).otherwise(1).cast("long").alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_repeats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, n) with tie and seen: a digest of role and text, and whether an earlier turn has both."""
    turns = turns.withColumn("tie", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)))
    turns = common.save(turns, "turns-damaged")
    there = turns.filter("n > 0").select("conv_id", "turn", "tie")
    first = there.groupBy("conv_id", "tie").agg(F.count("*").alias("k"), F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("f")).filter("k > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("tie").alias("t"), F.col("f.b").alias("first_turn"))
    # few turns say what another says; a conversation's turns are told apart by tie, so a hot conversation is no hot key here
    later = there.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("tie") == F.col("t"))).filter(~F.col("turn").eqNullSafe(F.col("first_turn")))
    later = later.select("conv_id", "turn", "tie")
    nothing = [F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(-1).cast("long").alias("n")]
    # a mark is a row with n = -1 that stands just before its turn, so no text moves for it
    return turns.unionByName(later.select("*", *nothing))


def symbol(role: str, text: str, seen: bool) -> str:
    """A turn's part in the grammar: D if it must go, else its role's initial, a capital one if it is cut off; x for other roles."""
    last = text.rstrip(" \t\n\v\f\r")[-1:]
    if not last or seen:
        return "D"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind if last in ".!?" else kind.upper()


def closed(layer: list[Best]) -> list[Best]:
    """The layer with turns inserted after it: from any state a user turn, from an open one an assistant turn, twice."""
    layer = list(layer)
    for _ in range(2):
        for state, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if layer[state] is not None:
                new = (layer[state][0] + INSERT, layer[state][1] + "I")
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
    return layer


def viterbi(symbols: str, start: int) -> list[Best]:
    """The least (cost, audit) for each state in which the turns can end, begun in start. Two audits of one cost and state are never
    the one a beginning of the other, as the turns they took are the same; so the lesser stays the lesser."""
    layer: list[Best] = [None] * STATES
    layer[start] = (0, "")
    layer = closed(layer)
    for m in re.finditer("D+|.", symbols):
        s = m[0]
        if s[0] == "D":
            # of turns that all must go nothing else can become; inserting after all of them gives the least audit
            layer = closed([b and (b[0] + DELETE * len(s), b[1] + s) for b in layer])
            continue
        more, role = TRUNCATED * s.isupper(), s.lower()
        new: list[Best] = [b and (b[0] + DELETE, b[1] + "D") for b in layer]
        for state, b in enumerate(layer):
            if b is None:
                continue
            for to_role, letter, cost in ((role, "K", 0), ("u", "R", REROLE), ("a", "R", REROLE)):
                to = NEXT.get((state, to_role))
                if to is not None and (new[to] is None or (b[0] + cost + more, b[1] + letter) < new[to]):
                    new[to] = (b[0] + cost + more, b[1] + letter)
        layer = closed(new)
    return layer


_short = lru_cache(maxsize=1 << 16)(viterbi)


def best_paths(symbols: str, start: int) -> list[Best]:
    """viterbi, remembered for short conversations, which are much alike."""
    return _short(symbols, start) if len(symbols) <= 32 else viterbi(symbols, start)


def repaired(turns: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[str], int]:
    """The lines of turns (role, text, how often) under the audit, and the state after them."""
    out = []
    queue = ((role, text) for role, text, n in turns for _ in range(n))
    for letter in audit:
        if letter == "I":
            role, text = ROLES["a" if state == 2 else "u"], ""
        else:
            role, text = next(queue)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES["a" if state == 2 else "u"]
        state = NEXT[state, role[0]]
        out.append(f"{role}:{text}")
    return out, state


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
BLOCK = "conv_id {id}, pid int, block long, whole boolean, n long, low {turn}, high {turn}, turns long, first_turn {turn}, last_turn {turn}, first_role string, last_role string, " + "".join(
    f"{c} long, " for c in COUNTS) + "ends array<struct<start:int,state:int,cost:long,audit:string>>, kept array<struct<role:string,text:string,n:long>>, cost long, audit string, sha string"


class Block:
    """What a run of a conversation's turns comes to."""

    def __init__(self, conv, pid: int, number: int, starts: tuple[int, ...]):
        self.conv, self.pid, self.number, self.starts = conv, pid, number, starts
        self.n = self.chars = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.symbols: list[str] = []
        self.kept: list[tuple[str, str, int]] = []

    def add(self, turn, role: str, text: str, n: int, seen: bool) -> None:
        s = symbol(role, text, seen)
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = self.high = turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.n:
            self.counts["illegal"] += self.last_role + initial not in ("su", "ua", "au")
        else:
            self.first_role = initial
        self.counts["illegal"] += n - 1
        self.last_role = initial
        blank = not text.strip(" \t\n\v\f\r")
        self.counts["blank"] += n * blank
        self.counts["duplicate"] += (n - 1 + seen) * (not blank)
        self.counts["truncated"] += s.isupper() and s != "D"
        self.symbols.append(s + "D" * (n - 1))
        self.kept.append((role, text, n))
        self.n += n
        self.chars += len(text) + n

    def full(self) -> bool:
        return len(self.kept) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self, whole: bool) -> tuple:
        symbols = "".join(self.symbols)
        ends = [(start, state, *b) for start in self.starts for state, b in enumerate(best_paths(symbols, start)) if b]
        head = (self.conv, self.pid, self.number, whole, self.n, self.low, self.high, self.turns, self.first_turn, self.last_turn, self.first_role, self.last_role, *self.counts.values())
        if not whole:
            return (*head, ends, self.kept, None, None, None)
        cost, audit = min((cost, audit) for start, state, cost, audit in ends if start == 0 and state in ENDS)
        lines, _ = repaired(self.kept, audit, 0)
        return (*head, None, None, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], kinds.names)


def _rows(batches):
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def blocks(turns: DataFrame) -> DataFrame:
    """Turns with their marks, in order, cut into blocks. Ranges of (conv_id, turn, tie) deal a long conversation to many tasks; a
    conversation that begins and ends within one task and block is whole, and its repair done."""
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "tie"]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order, "n").select("conv_id", "turn", "role", "text", "n", F.spark_partition_id().alias("pid"))
    schema = StructType.fromDDL(BLOCK.format(**{k: turns.schema[c].dataType.simpleString() for k, c in (("id", "conv_id"), ("turn", "turn"))}))

    def cut(batches):
        block, first, seen, out, chars = None, True, False, [], 0
        for conv, turn, role, text, n, pid in _rows(batches):
            if block is None or block.conv != conv:
                if block is not None:
                    out.append(block.row(block.number == 0 and not first))
                    chars += block.chars
                    first = False
                # a task's first conversation may have begun in another, so any state may be where it is
                block = Block(conv, pid, 0, tuple(range(STATES)) if first else (0,))
            elif n >= 0 and not seen and block.full():
                out.append(block.row(False))
                chars += block.chars
                block = Block(conv, pid, block.number + 1, tuple(range(STATES)))
            if n > 0:
                block.add(turn, role, text, n, seen)
            seen = n < 0
            if len(out) >= 512 or chars >= BLOCK_CHARS:
                yield _batch(out, schema)
                out, chars = [], 0
        if block is not None:
            out.append(block.row(False))
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(cut, schema)


class Path:
    """Audits as chains, as many share their beginnings; a link a block."""

    __slots__ = ("before", "state", "audit")

    def __init__(self, before: Path | None, state: int, audit: str):
        self.before, self.state, self.audit = before, state, audit


def _less(a: tuple[int, Path], b: tuple[int, Path]) -> bool:
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y, left, right = a[1], b[1], [], []
    while x is not y:
        left.append(x.audit)
        right.append(y.audit)
        x, y = x.before, y.before
    return "".join(reversed(left)) < "".join(reversed(right))


def chosen(parts: DataFrame) -> DataFrame:
    """Blocks (conv_id, pid, block, ends) to (conv_id, pid, block, start, part, total): the state that each begins in and its part of the
    conversation's least audit. The blocks of a conversation are gone through in order with four states; texts stay where they are."""
    schema = StructType.fromDDL(f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, pid int, block long, start int, part string, total long")

    def go(batches):
        def ended():
            cost, path = None, None
            for state in ENDS:
                if layer[state] is not None and (path is None or _less(layer[state], (cost, path))):
                    cost, path = layer[state]
            out = []
            for pid, block in reversed(spots):
                out.append((conv, pid, block, path.before.state, path.audit, cost))
                path = path.before
            for i in range(0, len(out), 256):
                yield _batch(out[i : i + 256], schema)

        conv, spots, layer = None, [], []
        for c, pid, block, ends in _rows(batches):
            if not spots or c != conv:
                if spots:
                    yield from ended()
                conv, spots, layer = c, [], [(0, Path(None, 0, "")), None, None, None]
            new: list = [None] * STATES
            for e in ends:
                if (b := layer[e["start"]]) is not None:
                    to = (b[0] + e["cost"], Path(b[1], e["state"], e["audit"]))
                    if new[e["state"]] is None or _less(to, new[e["state"]]):
                        new[e["state"]] = to
            layer = new
            spots.append((pid, block))
        if spots:
            yield from ended()

    ordered = parts.select("conv_id", "pid", "block", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "block")
    return ordered.mapInArrow(go, schema)


RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def joined(parts: DataFrame) -> DataFrame:
    """Conversations of several blocks. Lines are made block by block, in parallel; the digest of a conversation, which has no other way, takes
    them one block after the other."""
    on = chosen(parts).select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), F.col("block").alias("b"), "start", "part", "total")
    both = parts.join(on, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")) & (F.col("block") == F.col("b"))).drop("c", "p", "b")

    @F.udf("string", useArrow=False)
    def lines(kept, part, start):
        out, _ = repaired([tuple(k) for k in kept], part, start)
        return "\n".join(out) if out else None

    both = both.select("conv_id", "pid", "block", "n", "low", "high", "turns", "first_turn", "last_turn", "first_role", "last_role", *COUNTS, "total", "part", lines("kept", "part", "start").alias("lines"))
    schema = StructType.fromDDL(RESULT.format(id=parts.schema["conv_id"].dataType.simpleString()))

    def go(batches):
        def ended():
            gaps = high - low + 1 - turns if turns else 0
            return _batch([(conv, gaps, *sums, total, "".join(audit), digest.hexdigest())], schema)

        started = False
        for c, _, _, n, lo, hi, t, first_turn, last_turn, first_role, last_role, *counts, cost, part, lines in _rows(batches):
            if not started or c != conv:
                if started:
                    yield ended()
                started, conv, total, low, high, turns, before_turn, before_role = True, c, cost, None, None, 0, None, None
                sums, audit, digest, any_line = [0] * len(COUNTS), [], hashlib.sha256(), False
            sums = [x + y for x, y in zip(sums, counts)]
            audit.append(part)
            if lines is not None:
                digest.update(("\n" * any_line + lines).encode())
                any_line = True
            if n:
                if before_role is not None:
                    sums[-1] += before_role + first_role not in ("su", "ua", "au")
                before_role = last_role
            if t:
                turns += t - (turns > 0 and first_turn == before_turn)
                low, high, before_turn = lo if low is None else min(low, lo), hi if high is None else max(high, hi), last_turn
        if started:
            yield ended()

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "block")
    return ordered.mapInArrow(go, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to RESULT, a row a conv_id, null among them. Turns that are equal in turn stand in the
    order of a digest of role and text, so equal ones stand together."""
    cut = common.save(blocks(with_repeats(damaged(conversations))), "turns-blocks")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0).cast("long").alias("gaps")
    done = cut.filter("whole").select("conv_id", gaps, *COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return done.unionByName(joined(cut.filter("NOT whole")))


def op11_turns(spark, sf_dir: str) -> DataFrame:
    """A row a conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space, a null turn comes first, a null conv_id is a conversation of its own; an empty role fits no
    state, so its turn is deleted or gets another; equal rows count each and stand side by side; texts and conversations may be of any
    length; an empty table gives no rows; other columns take no part.
    """
    with common.passing(spark):
        rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
        return common.save(repair(rows), "turns", stays=True)


def _sql() -> str:
    """The same by a recursive query: a state's least cost, of 12 digits, stands before its audit, so the lesser text is the better."""

    def add(s: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(left({s}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({s}, 13) || '{letter}')"

    def turn(s: str, role: str) -> str:
        return f"CASE WHEN must_go THEN NULL WHEN initial = '{role}' THEN {add(s, 'more', 'K')} ELSE {add(s, f'more + {REROLE}', 'R')} END"

    gone = {k: add(f"dp.s{k}", str(DELETE), "D") for k in range(STATES)}
    system = f"CASE WHEN NOT must_go AND initial = 's' THEN {add('dp.s0', 'more', 'K')} END"
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH {common.CRC32}
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {common.crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || ':' || text)) AS i
  FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated,
         NOT regexp_matches(text, '[.!?]{blank}*$') AS cut_off, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), faults AS (
  SELECT conv_id, CAST(CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE repeated AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut_off AND NOT blank AND NOT repeated) AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, i, initial, blank OR repeated AS must_go, CASE WHEN cut_off THEN {TRUNCATED} ELSE 0 END AS more FROM judged
), dp AS (
  SELECT conv_id, 0 AS i, '000000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '{INSERT:012d}I' AS s2, '{2 * INSERT:012d}II' AS s3 FROM faults
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, least(n3, {add("s2", str(INSERT), "I")}) AS s3 FROM (
    SELECT conv_id, i, n0 AS s0, n1 AS s1, least(n2, {add("n0", str(INSERT), "I")}, {add("n1", str(INSERT), "I")}, {add("n3", str(INSERT), "I")}) AS s2, n3 FROM (
      SELECT dp.conv_id, dp.i + 1 AS i, {gone[0]} AS n0, least({gone[1]}, {system}) AS n1,
             least({gone[2]}, {", ".join(turn(f"dp.s{k}", "u") for k in (0, 1, 3))}) AS n2, least({gone[3]}, {turn("dp.s2", "a")}) AS n3
      FROM dp JOIN steps ON dp.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.i = dp.i + 1))
), least_of AS (
  SELECT f.conv_id, least(s0, s3) AS best FROM faults f JOIN dp ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = f.n
), letters AS (
  SELECT conv_id, k, substr(best, 12 + k, 1) AS letter, k - strlen(replace(substr(best, 13, k), 'I', '')) AS inserted FROM (SELECT conv_id, best, unnest(range(1, length(best) - 11)) AS k FROM least_of)
), emitted AS (
  SELECT l.conv_id, k, letter, p.role, p.text, row_number() OVER w AS place, first_value(letter = 'K' AND left(p.role, 1) = 's') OVER w AS with_system
  FROM letters l LEFT JOIN placed p ON letter <> 'I' AND p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.i = l.k - l.inserted
  WHERE letter <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY k)
), written AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + CAST(with_system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS lines
  FROM emitted GROUP BY conv_id
)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(CAST(left(b.best, 12) AS BIGINT), 0) AS cost, coalesce(substr(b.best, 13), '') AS audit, sha256(coalesce(w.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN least_of b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
