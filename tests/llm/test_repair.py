"""Conversation repair against trying every edit script, and the query against a plain repair."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewrack.llm import repair

CONVS = "conv_id long, turn long, role string, text string, nth string, code string, fault string"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def scripts(rows, inserts):
    """Every (cost, audit, output) with at most so many insertions in a row; rows: (initial, must go, truncated, role, text)."""
    gaps = [[""] + ["".join(x) for k in range(1, inserts + 1) for x in itertools.product("ua", repeat=k)]] * (len(rows) + 1)
    edits = [["D"] if must else ["D", "K", "u", "a"] for _, must, *_ in rows]
    for ins in itertools.product(*gaps):
        for es in itertools.product(*edits):
            cost, audit, roles, out = 0, "", "", []
            for k in range(len(rows) + 1):
                cost, audit, roles = cost + 5 * len(ins[k]), audit + "I" * len(ins[k]), roles + ins[k]
                out += [repair.ROLES[c] + ":" for c in ins[k]]
                if k == len(rows):
                    break
                initial, _, cut, role, text = rows[k]
                if es[k] == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                cost += 5 * cut + (es[k] != "K")
                audit += "K" if es[k] == "K" else "R"
                roles += initial if es[k] == "K" else es[k]
                out.append(f"{role if es[k] == 'K' else repair.ROLES[es[k]]}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit, "\n".join(out)


def test_solve_equals_trying_every_script():
    seen = 0
    for n in range(5):
        for codes in itertools.product("suaoUAd", repeat=n):
            s = "".join(codes)
            if n == 4 and zlib.crc32(s.encode()) % 12:
                continue
            rows = [(c.lower(), c == "d", c.isupper(), c.lower(), str(k)) for k, c in enumerate(codes)]
            cost, audit, out = min(scripts(rows, 1 if n > 2 else 2), key=lambda x: x[:2])
            got = repair.solve(s)
            assert got[:2] == (cost, audit), s
            seen += 1
            lines = []
            for (_, _, _, role, text), step in itertools.zip_longest(rows, got[2], fillvalue=("", "", "", "", "")):
                lines += [repair.ROLES[c] + ":" for c in step[:-2]]
                if step[-2] in "KR":
                    lines.append(f"{role if step[-2] == 'K' else repair.ROLES[step[-1]]}:{text}")
            assert "\n".join(lines) == out
    assert seen > 500


def test_long_signatures_need_no_deep_recursion():
    cost, audit, steps = repair.solve("ua" * 50_000 + "u")
    assert (cost, len(audit), len(steps)) == (2, 100_001, 100_001)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            mine += [(turn is not None, turn or 0, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        mine.sort()
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, role, text in mine:
            shown = SHOWN.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            marked.append((role[:1] if role[:1] in list("sua") else "o", fault in ("blank", "duplicate"), fault == "truncated", role, text))
        turns = [m[1] for m in mine if m[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = min(scripts(marked, 1), key=lambda x: x[:2])
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def rows_of(convs=90):
    r = random.Random(8)
    rows = []
    for k in range(convs):
        for i in range(r.randint(1, 4)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "unit", "User"])
            text = r.choice([None, "", " \t", "ok.", "ok", "ok. \n", "why?", "a\nb!", "é…", "$1.", "ok."])
            rows.append((k, r.choice([i, i, i, i * 3, None]), role, text))
    return [*rows, (None, 1, "user", "q?"), (None, None, None, None), (500, 5, "tool", "x" * 300_000 + "."), (501, -3, "user", "a."), (501, 4, "assistant", "b.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], CONVS)


@pytest.mark.parametrize("limits", [(100_000, 8_000_000), (100_000, 3)])
def test_repair_equals_a_plain_repair(spark, limits):
    rows = rows_of()
    convs = frame(spark, rows)
    got = repair.repair(repair.damaged(convs), convs, *limits)
    got = {x.conv_id: tuple(x)[1:-1] for x in got.collect()}
    assert got == brute(rows) and sum(x[5] > 2 for x in got.values()) > 20


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_conversation_repair(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
