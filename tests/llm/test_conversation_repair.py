import hashlib
import random
import re
import sys
from functools import lru_cache
from itertools import product
from zlib import crc32

import pytest

from ledgerloom.llm.conversation_repair import END, START, Survivors, damage, kind_of, matrix, repair, step

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if hit:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows, original):
    """Faults and the cheapest, least edits by recursion over whole strings of edits."""
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in own if t is not None]
        must, add, n, seen = [], [], {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in own:
            body = text.strip(WS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            must.append(fault in ("blank", "duplicate"))
            add.append(5 * (fault == "truncated"))
            if fault:
                n[fault] += 1
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}

        @lru_cache(None)
        def best(i, last, inserted=0):
            """(cost, edits, roles) of the rest."""
            found = [(0, "", ())] if i == len(own) and last in ("", "a") else []
            name = {"u": "user", "a": "assistant"}
            if inserted < 3:
                for r in follow[last].replace("s", ""):
                    c, e, o = best(i, r, inserted + 1)
                    found.append((c + 5, "I" + e, (name[r] + ":", *o)))
            if i < len(own):
                _, role, text = own[i]
                c, e, o = best(i + 1, last)
                found.append((c + 2, "D" + e, o))
                if not must[i]:
                    if role[:1] and role[:1] in follow[last]:
                        c, e, o = best(i + 1, role[0])
                        found.append((c + add[i], "K" + e, (f"{role}:{text}", *o)))
                    for r in follow[last].replace("s", ""):
                        c, e, o = best(i + 1, r)
                        found.append((c + 1 + add[i], "R" + e, (f"{name[r]}:{text}", *o)))
            return min(found, default=(10**9, "", ()))

        cost, edits, lines = best(0, "")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(r, lengths):
    rows = []
    for conv, n in lengths.items():
        for turn in range(n):
            rows.append((conv, r.choice([turn, turn, turn, turn * 2, None, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser", "agent"]), r.choice(["", None, " \n", "Yes.", "No", "Why?", "ü!", f"{r.random()}.", f"{r.random()}", "a. \t"])))
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_equals_recursion_over_whole_strings(spark, chunk):
    r = random.Random(chunk)
    rows = conversations(r, {i: r.choice([1, 2, 3, 5, 9, 14]) for i in range(150)} | {None: 6, 1000: 90})
    rows += [(2000, t, "user", "ok.") for t in range(60)] + [(2001, None, "user", "ok.")] * 40
    frame = spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA + ", body string, kind int").repartition(5)
    assert got(repair(damage(frame), chunk)) == brute(damaged(rows), rows)


def test_alternating_long_conversation_spans_chunks(spark):
    sys.setrecursionlimit(50_000)
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(400)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    assert got(repair(damage(spark.createDataFrame(rows, SCHEMA)), 64)) == brute(damaged(rows), rows)
    rows = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(20_000)], SCHEMA)
    assert got(repair(damage(rows), 64)) == got(repair(damage(rows), 10**6))


def test_a_conversation_whose_rows_are_all_dropped_and_an_empty_table(spark):
    rows = [(c, 0, "user", "a.") for c in range(100)]
    gone = {c for c, *_ in rows} - {c for c, *_ in damaged(rows)}
    found = got(repair(damage(spark.createDataFrame(rows, SCHEMA))))
    assert gone and all(found[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert got(repair(damage(spark.createDataFrame([], SCHEMA)))) == {}


def test_survivors_hold_a_bounded_tree_and_matrices_agree():
    r = random.Random(1)
    kinds = bytes(r.choice([1, 2, 1, 2, 1, 2, 0, 3, 5, 6, 8, 9]) for _ in range(20_000))
    search = Survivors()
    for k in reversed(kinds):
        search.feed(k)
    assert search.most_held < 200 and len(search.decided) > 19_900
    assert search.cost(START) == int((matrix(kinds) + list(END)).min(1)[START])
    assert len(search.edits(START)[0].replace("I", "")) == len(kinds)


def test_tied_edits_take_the_least_letter():
    assert kind_of("system", False) == 0 and kind_of("", True) == 7
    for kind, after in product(range(10), [END, (2, 2, 0, 0), (0, 0, 5, 0)]):
        cost, words, _ = step(kind, after)
        assert all(w.rstrip("DKR") in ("", "I", "II", "III") and w for w in words) and min(cost) >= 0
