"""Chat formatting against a plain formatter, with nulls, ties, wrong turns and control strings in texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import chat

CONVS = "conv_id long, turn long, role string, text string, nth string, segments long, ok string, before string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TURN]", "\\", "[", "<", "s>", "/INST]", "]", " ", "x", "$1", "\n", "é", "[\\INST]", "<\\\\/s>"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], CONVS)


def text(r):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows_of(seed=5, convs=60):
    r = random.Random(seed)
    rows = []
    for k in range(convs):
        for i in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "[INST]", "</s>"]) if k % 3 == 0 else ("user", "assistant")[i % 2]
            rows.append((k, None if r.random() < 0.05 else i, role, None if r.random() < 0.05 else text(r)))
    return rows + [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (900, 0, "user", "[INST]" * 40_000), (901, 0, "assistant", ""), (902, 1, "user", "x"), (902, 1, "user", "x")]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    r = random.Random(1)
    ts = [text(r) for _ in range(3000)] + ["", "\\" * 9 + "[" + "\\" * 9 + "INST]"]
    d = spark.createDataFrame([(t,) for t in ts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    d = d.withColumn("u", chat.unescape(F.col("e")))
    for x in d.collect():
        assert x.u == x.t and not any(c in x.e for c in chat.INSTRUCT.controls)


def test_templates_that_cannot_be_read_back_are_refused():
    t = chat.INSTRUCT
    for change in ({"controls": (*t.controls, "[A[B")}, {"controls": (*t.controls, "<\\x>")}, {"other": ("[INST]", "[TEXT]", "[/TURN]")}, {"begin": "<x>"}):
        with pytest.raises(ValueError):
            chat.Template(**{k: getattr(t, k) for k in ("begin", "roles", "other", "ends", "controls")} | change)


def test_read_back_equals_the_input(spark):
    rows = rows_of()
    got = {x.conv_id: x for x in chat.read_back(chat.formatted(frame(spark, rows))).collect()}
    convs = {}
    for c, turn, role, t in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", t or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns, x = sorted(turns), got[c]
        assert [(t.role, t.text) for t in x.turns] == [(t[2], t[3]) for t in turns]
        assert x.loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
        state, fault = None, None
        for i, t in enumerate(turns, 1):
            ok = {"system": state is None, "user": state in (None, "system", "assistant"), "assistant": state == "user"}.get(t[2], False)
            fault = fault or (None if ok else i)
            state = t[2]
        assert (x.first_fault, x.valid) == (fault, fault is None and state == "assistant")
    assert sum(x.valid for x in got.values()) > 10 and sum(not x.valid for x in got.values()) > 10


def test_segments_bear_loss_in_assistant_texts_only(spark):
    x = chat.formatted(frame(spark, [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST]"), (1, 3, "tool", "t")])).first()
    assert [(s.text, s.loss) for s in x.segments] == [
        ("<s>", False), ("[SYS] ", False), ("be", False), (" [/SYS]", False), ("[INST] ", False), ("hi", False), (" [/INST]", False),
        ("[\\INST]", True), ("</s>", False), ("[ROLE]", False), ("tool", False), ("[TEXT] ", False), ("t", False), (" [/TURN]", False),
    ]
    assert (x.valid, x.first_fault) == (False, 4)


def test_query_and_empty_table(spark, tmp_path):
    rows = [r for r in rows_of(7) if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in chat.op11_chat_formatting(spark, str(tmp_path)).collect()}
    both = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    for c in {r[0] for r in rows} | {-1}:
        turns = sorted((t is not None, t or 0, role or "", x or "") for k, t, role, x in [*rows, *both] if k == c)
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(said), sha(said))
    assert len(got) == len({r[0] for r in rows}) + 1
    frame(spark, []).write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert [x.conv_id for x in chat.op11_chat_formatting(spark, f"{tmp_path}/e").collect()] == [-1]
