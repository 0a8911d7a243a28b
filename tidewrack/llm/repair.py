"""Conversation structure repair: damaged conversations, each different role and fault sequence solved once.

A conversation's rows become a signature, a character a row: the role's initial (s, u, a, or o for others; upper case if the
row is truncated), or d where it must go (blank or duplicate). Each distinct signature is solved once by a memoised
recursion over (rows left, last role), evaluated from its far end so that its depth doesn't grow with the conversation; the
audits join back on the signature's hash and the edits are replayed on the rows, each row with its own edit.

Edits: K keeps a row (0; 5 more if truncated), R gives it the role user or assistant (1, likewise), D deletes it (2), I inserts
an empty user or assistant turn (5). The result's role initials are nothing, or an s that may be left out and then pairs ua.

Defined cases: rows come by turn (nulls first), equal turns by role, then text, copies next to each other; a null conv_id, turn,
role or text is one space in the damage's key and, for role and text, in the row; rows without conv_id are one conversation; an
empty role, or one of another initial, fits nothing; equal rows are duplicates; an empty table gives an empty one; columns other
than conv_id, turn, role and text play no part. Texts are hashed row by row in sorted partitions: no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, last, lean, ship, table

#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What a row with such an initial leads to after each state: "" nothing yet, s, u, a.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that may be written after each state, other than s.
WRITE = {"": "u", "s": "u", "u": "a", "a": "u"}
STATES, FINAL = ("", "s", "u", "a"), ("", "a")
ROLES = {"u": "user", "a": "assistant"}
SHOWN = r"[^\x20\x09-\x0D]"
NEVER = 1 << 60
#: Rows and characters of signatures that are broadcast, and copies of a signature where they are not.
ROWS, CHARS, SALTS = 100_000, 8_000_000, 16


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of convs with seeded faults: conv_id, turn, role, text, copy."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    d = convs.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copy) with nth (from 1 in its conversation), fault (blank, duplicate, truncated or null), code, illegal and new (a turn's first row)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    d = rows.withColumn("nth", F.row_number().over(order)).withColumn("initial", F.substring("role", 1, 1))
    d = d.withColumn("illegal", F.lag("initial").over(order).isNotNull() & ~F.concat(F.lag("initial").over(order), F.col("initial")).isin("su", "ua", "au"))
    again = F.col("nth") > F.min("nth").over(Window.partitionBy("conv_id", "role", "text"))
    ending = F.regexp_extract("text", rf"({SHOWN})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ending == "", "blank").when(again, "duplicate").when(~ending.isin(".", "!", "?"), "truncated")
    d = d.withColumn("fault", fault)
    d = d.withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return d.select("conv_id", "turn", "role", "text", "nth", "fault", "illegal", "new", code.alias("code"))


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal (of what faults() gives), signature."""
    count = lambda c: F.count(F.when(c, 1)).alias
    gaps = F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new"), 1))
    codes = F.sort_array(F.collect_list(F.struct("nth", "code")))
    return rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(count(F.col("fault") == x)(x) for x in ("blank", "duplicate", "truncated")), count(F.col("illegal"))("illegal"),
        F.array_join(F.transform(codes, lambda x: x.getField("code")), "").alias("signature"),
    )


def solve(signature: str) -> tuple[int, str, list[str]]:
    """The least cost, the ASCII-least audit of that cost, and the steps to replay: for each row the roles inserted before it,
    its edit and the role written; one step more, "." for the edit, if turns are inserted at the end."""
    n = len(signature)

    def edits(i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        """(edit, cost, next row, next state) in ASCII order."""
        if i < n:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, WRITE[state]
        c = signature[i] if i < n else "d"
        if c != "d":
            more, kept = TRUNCATED * c.isupper(), NEXT.get((state, c.lower()))
            if kept:
                yield "K", more, i + 1, kept
            yield "R", RENAME + more, i + 1, WRITE[state]

    memo: dict[tuple[int, str], int] = {(n, s): 0 if s in FINAL else NEVER for s in STATES}
    for i in range(n, -1, -1):
        # costs without inserting first, then with one insertion and more of them, until none makes it cheaper
        for s in STATES:
            memo[i, s] = min([memo.get((i, s), NEVER), *(cost + memo[to, t] for e, cost, to, t in edits(i, s) if e != "I")])
        better = True
        while better:
            better = False
            for s in STATES:
                if (cost := INSERT + memo[i, WRITE[s]]) < memo[i, s]:
                    memo[i, s], better = cost, True
    audit, steps, before, i, state = [], [], "", 0, ""
    while i < n or state not in FINAL:
        e, _, to, t = next(x for x in edits(i, state) if x[1] + memo[x[2], x[3]] == memo[i, state])
        audit.append(e)
        if e == "I":
            before += t
        else:
            steps.append(f"{before}{e}{'-' if e == 'D' else t}")
            before = ""
        i, state = to, t
    return memo[0, ""], "".join(audit), [*steps, *([f"{before}.-"] if before else [])]


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in batch.column("signature").to_pylist():
            cost, audit, steps = solve(s)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([cost], pa.int64()), pa.array([audit]), pa.array([steps], pa.list_(pa.string()))], ["signature", "cost", "audit", "steps"])


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit, steps: a row for each distinct signature."""
    ship(signatures.sparkSession)
    return signatures.select("signature").distinct().mapInArrow(lean(_solve_all), "signature string, cost long, audit string, steps array<string>")


def _with_audits(per: DataFrame, audits: DataFrame, rows: int, chars: int) -> DataFrame:
    """per with cost, audit and steps; a signature that many conversations share is dealt out."""
    a = audits.select(F.col("signature").alias("a_signature"), "cost", "audit", "steps")
    # the audits' size in characters bounds what is broadcast
    if bounded(a, rows) and (a.agg(F.sum(F.length("a_signature"))).first()[0] or 0) <= chars:
        return per.join(F.broadcast(a), F.col("signature") == F.col("a_signature")).drop("a_signature")
    a = a.withColumn("a_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per = per.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return per.join(a, (F.col("signature") == F.col("a_signature")) & (F.col("salt") == F.col("a_salt"))).drop("a_signature", "salt", "a_salt")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), text, F.lit("\n"))


def replayed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, nth, lines: what each row has become, with turns inserted before it; each turn ends with a line end."""
    s = audited.select(F.col("conv_id").alias("s_conv"), F.posexplode("steps").alias("at", "step"))
    s = s.select("s_conv", (F.col("at") + 1).alias("s_nth"), F.upper(F.expr("substring(step, 1, length(step) - 2)")).alias("before"), F.substring("step", -2, 1).alias("edit"), F.substring("step", -1, 1).alias("to"))
    d = s.join(rows.select("conv_id", "nth", "role", "text"), F.col("s_conv").eqNullSafe(F.col("conv_id")) & (F.col("s_nth") == F.col("nth")), "left")
    before = F.col("before")
    for initial, role in ROLES.items():  # no role name holds an upper-case letter
        before = F.replace(before, F.lit(initial.upper()), F.lit(f"{role}:\n"))
    new = F.when(F.col("to") == "u", ROLES["u"]).otherwise(ROLES["a"])
    row = F.when(F.col("edit") == "K", _turn(F.col("role"), F.col("text"))).when(F.col("edit") == "R", _turn(new, F.col("text"))).otherwise("")
    return d.select(F.col("s_conv").alias("conv_id"), F.col("s_nth").alias("nth"), F.concat(before, row).alias("lines"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id and nth to conv_id, repaired_sha256, without the last line end."""
    now, h, open_ = None, None, b""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if h is None or conv != now:
                if h is not None:
                    yield done()
                now, h, open_ = conv, hashlib.sha256(), b""
            if lines:
                h.update(open_ + lines.encode()[:-1])
                open_ = b"\n"
    if h is not None:
        yield done()


def digests(lines: DataFrame) -> DataFrame:
    """conv_id (long), repaired_sha256 of what replayed() gives."""
    d = lines.select(F.col("conv_id").cast("long").alias("conv_id"), "nth", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return d.select("conv_id", "lines").mapInArrow(lean(_digest), "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, convs: DataFrame, limit_rows: int = ROWS, limit_chars: int = CHARS) -> DataFrame:
    """Each conv_id of convs with counts, cost, audit and digest of its repaired rows; rows: conv_id, turn, role, text, copy."""
    marked = cut(faults(rows), "marked")
    per = cut(summaries(marked), "signatures")
    audits = cut(solved(per), "audits")
    audited = _with_audits(per, audits, limit_rows, limit_chars)
    sha = digests(replayed(marked, audited)).withColumnRenamed("conv_id", "d_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = audited.select(F.col("conv_id").alias("f_conv"), *counts, "audit", "signature")
    ids = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    d = ids.join(found, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = d.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"), F.coalesce("signature", F.lit("")).alias("signature"))
    return last(out, "repaired", marked, per, audits)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(convs), convs).drop("signature")


_CRC = [0] * 256
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = _c >> 1 ^ 0xEDB88320 * (_c & 1)
    _CRC[_k] = _c


def _sql() -> str:
    """The forward form in DuckDB: the best audit and text that reach each state after each row."""
    go = lambda x, cost, edit, line: f"CASE WHEN {x} IS NOT NULL THEN [lpad(({x}[1]::BIGINT + {cost})::VARCHAR, 12, '0'), {x}[2] || '{edit}', {x}[3] || {line}] END"
    best = lambda *xs: f"list_aggregate([{', '.join(xs)}], 'min')"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    line = lambda role: f"'{role}:' || text || chr(10)"
    empty, same, more = lambda role: f"'{role}:' || chr(10)", "role || ':' || text || chr(10)", f"(CASE WHEN code <> lower(code) THEN {TRUNCATED} ELSE 0 END)"
    u = best("xu", *(go(x, INSERT, "I", empty("user")) for x in ("x0", "xs", "xa")))
    insert = f"SELECT * EXCLUDE (yu), yu, {best('xa', go('yu', INSERT, 'I', empty('assistant')))} AS ya FROM (SELECT *, {u} AS yu FROM {{0}})"
    gone = lambda x: go(x, DELETE, "D", "''")
    stays = lambda x, c, role: f"{when(f'lower(code) = {c!r}', go(x, more, 'K', same))}, {when('code <> ' + repr('d'), go(x, f'{RENAME} + {more}', 'R', line(role)))}"
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
    lambda a, b: xor(a >> 8, ({_CRC}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS lot FROM src),
dmg AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE lot <> 0),
o AS (SELECT *, row_number() OVER w AS nth, lag(left(role, 1)) OVER w || left(role, 1) AS two, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
    FROM dmg WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > min(nth) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
k AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE CASE WHEN fault = 'truncated' THEN upper(r) ELSE r END END AS code
    FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r FROM f)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id),
x AS (SELECT conv_id, 0::BIGINT AS i, [lpad('0', 12, '0'), '', ''] AS x0, NULL::VARCHAR[] AS xs, NULL::VARCHAR[] AS xu, NULL::VARCHAR[] AS xa FROM n
  UNION ALL SELECT conv_id, i + 1, {gone('x0')}, {best(gone('xs'), when("lower(code) = 's'", go('x0', more, 'K', same)))},
    {best(gone('yu'), *(stays(s, 'u', 'user') for s in ('x0', 'xs', 'ya')))}, {best(gone('ya'), stays('yu', 'a', 'assistant'))}
  FROM ({insert.format("(SELECT x.*, k.role, k.text, k.code FROM x JOIN k ON x.conv_id IS NOT DISTINCT FROM k.conv_id AND k.nth = x.i + 1)")})),
e AS (SELECT conv_id, {best('x0', 'ya')} AS best FROM ({insert.format("(SELECT x.* FROM x JOIN n ON x.conv_id IS NOT DISTINCT FROM n.conv_id AND x.i = n.n)")}))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1]::BIGINT, 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(best[3][:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = _sql()
