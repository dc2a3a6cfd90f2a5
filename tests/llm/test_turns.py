"""Conversation repair: the search against all edits, the query against a plain version, long conversations in blocks."""

import hashlib
import random
import zlib

import pytest

from lossgrid.llm import turns

SPACE = " \t\n\v\f\r"


def every_edit(symbols):
    """The least (cost, audit) of all edits, by trying them."""
    best = None

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(symbols) and state in turns.ENDS and (best is None or (cost, audit) < best):
            best = (cost, audit)
        for role in ("u", "a") if inserted < 3 else ():
            if (state, role) in turns.NEXT:
                go(i, turns.NEXT[state, role], cost + 5, audit + "I", inserted + 1)
        if i == len(symbols):
            return
        go(i + 1, state, cost + 2, audit + "D", 0)
        if symbols[i] != "D":
            for role, letter, extra in ((symbols[i].lower(), "K", 0), ("u", "R", 1), ("a", "R", 1)):
                if (state, role) in turns.NEXT:
                    go(i + 1, turns.NEXT[state, role], cost + extra + 5 * symbols[i].isupper(), audit + letter, 0)

    go(0, 0, 0, "", 0)
    return best


def test_search_against_all_edits():
    rng = random.Random(3)
    for _ in range(1500):
        symbols = "".join(rng.choice("suaxSUAXDD") for _ in range(rng.randrange(6)))
        assert min(b for s, b in enumerate(turns.viterbi(symbols, 0)) if b and s in turns.ENDS) == every_edit(symbols), symbols


def plain(rows):
    """The contract, conversation by conversation in Python."""
    text = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, words in rows:
        there = by.setdefault(conv, [])
        d = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        words = "" if d == 1 else "".join(c for c in words if c not in ".!?") if d == 2 else words
        there += [(turn, "user" if d == 4 else role, words)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = {}
    for conv, there in by.items():
        tie = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}:{r[2]}".encode()).digest()
        there.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        known = [t for t, *_ in there if t is not None]
        counts, symbols, seen = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), "", set()
        for k, (_, role, words) in enumerate(there):
            end = words.rstrip(SPACE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, words) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, words))
            if fault:
                counts[fault] += 1
            counts["illegal"] += k > 0 and there[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        layer = turns.viterbi(symbols, 0)
        cost, audit = min(b for s, b in enumerate(layer) if b and s in turns.ENDS)
        lines, at, state = [], 0, 0
        for letter in audit:
            role, words = ("assistant" if state == 2 else "user"), ""
            if letter != "I":
                _, kept, words = there[at]
                at += 1
                role = kept if letter == "K" else role
            if letter != "D":
                state = turns.NEXT[state, role[0]]
                lines.append(f"{role}:{words}")
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows(rng):
    texts = ["Yes.", "no", "What? ", "", None, " \n", "Well!\t", "é", "a.b", "x" * 300]
    rows = [(c, rng.choice([None, *range(7)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randrange(1, 9))]
    return rows + rows[:20]


@pytest.mark.parametrize("block_rows, long", [(2048, 0), (3, 0), (7, 900)])
def test_query_against_plain_version(spark, monkeypatch, block_rows, long):
    """Blocks of a few turns and one conversation of a third of all rows give what whole conversations give."""
    monkeypatch.setattr(turns, "BLOCK_ROWS", block_rows)
    rng = random.Random(block_rows)
    rows = odd_rows(rng) + [(1000, i % (long // 2), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"word {i}.", "cut off", ""])) for i in range(long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in turns.repair(df).collect()}
    assert got == plain(rows)


def test_dropped_conversations_and_repeats(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    plainly = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    df = spark.createDataFrame([(gone, 0, "user", "Hi."), *[(plainly, 0, "user", "Hi.")] * 5000], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in turns.repair(df).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    r = got[plainly]
    # one turn left of all the equal ones: to keep and answer it costs 5, to delete it 2
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (4999, 4999, 2 * 5000, "D" * 5000)
