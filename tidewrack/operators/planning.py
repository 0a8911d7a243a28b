"""Inventory, snapshots, routing and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shared import cut, last, maybe_broadcast
from .ordered import PLACE, ranged


def inventory(files: DataFrame, max_files: int = 200, max_bytes: int = 200_000) -> DataFrame:
    """Files that are not ignored and not over max_bytes, with their band; the first max_files by (band, path), 0 for all."""
    kept = files.where(~C.is_ignored(F.col("relative")) & (F.col("size") <= max_bytes)).withColumn("priority_band", C.band(F.col("relative")))
    return kept.orderBy("priority_band", "relative").limit(max_files) if max_files > 0 else kept


def inventory_stats(files: DataFrame, max_files: int = 200, max_bytes: int = 200_000) -> DataFrame:
    n = inventory(files, 0, max_bytes).agg(F.count("*").alias("total_matched"))
    used = F.least(F.col("total_matched"), F.lit(max_files)) if max_files > 0 else F.col("total_matched")
    return n.select("total_matched", used.alias("n_files"), (F.col("total_matched") > used).alias("truncated"))


def fingerprint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, changed, deleted, unchanged) of two snapshots (path, sha256)."""
    j = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return j.select("path", status.alias("status"))


def classify_deleted(diff: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Deleted paths: `dropped` if still on disk (out of the inventory), else `removed`."""
    d, disk = diff.where("status = 'deleted'").select("path"), on_disk.select(F.col("relative").alias("disk")).distinct()
    return d.join(disk, d.path == disk.disk, "left").select("path", F.when(F.col("disk").isNotNull(), "dropped").otherwise("removed").alias("kind"))


def adaptive_pack(files: DataFrame, diff: DataFrame, mode: str) -> DataFrame:
    """full: all; changed: files of the delta; auto: the delta and band 1, or all if the delta is empty."""
    if mode == "full":
        return files
    delta = diff.where("status in ('added', 'changed')").select(F.col("path").alias("d_path"))
    j = files.join(delta, files.relative == delta.d_path, "left")
    if mode == "changed":
        return j.where("d_path is not null").drop("d_path")
    empty = delta.agg((F.count("*") == 0).alias("e")).scalar()
    return j.where(F.col("d_path").isNotNull() | (F.col("priority_band") <= 1) | empty).drop("d_path")


def triage_hits(issues: DataFrame, changed: DataFrame | None = None, floor: str = "HIGH", sources=("scanner",)) -> DataFrame:
    """Issues of the sources at the floor or over it, in changed files, with pack_file."""
    hits = issues.where(C.infer_source(F.col("source"), F.col("category")).isin(*sources) & C.at_least(F.col("severity"), floor)).withColumn("pack_file", C.norm_route(F.col("file")))
    return hits if changed is None else hits.join(changed.select(C.norm_route(F.col("relative")).alias("pack_file")).distinct(), "pack_file", "left_semi")


def sorted_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("band", "id")


def triage(issues: DataFrame, changed: DataFrame | None = None, floor: str = "HIGH", max_files: int = 8, sources=("scanner",)) -> DataFrame:
    """pack: file, rank of the first max_files files with a hit, in order of hits. changed: null is no limit, empty is none.

    A hit outside the available files stays in the pack.
    """
    hits = triage_hits(issues, changed, floor, sources)
    firsts = hits.where("pack_file <> ''").groupBy("pack_file").agg(F.min("ord").alias("ord"))
    return firsts.orderBy("ord", "pack_file").limit(max(1, max_files))


def triage_plan(issues: DataFrame, available: DataFrame, changed: DataFrame | None = None, routing: bool = True, floor: str = "HIGH", max_files: int = 8, sources=("scanner",), on_clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pack (pack_file, ord), and one row: invoke, bypassed, n_hits, n_files, truncated, note.

    Without routing, and without hits where on_clean allows it, all available files (relative) are the pack.
    """
    every = available.select(C.norm_route(F.col("relative")).alias("pack_file")).distinct().withColumn("ord", F.lit(None).cast("long"))
    if not routing:
        n = every.agg(F.count("*").alias("n_files"))
        return every, n.select(F.lit(True).alias("invoke"), F.lit(False).alias("bypassed"), F.lit(0).cast("long").alias("n_hits"), "n_files", F.lit(False).alias("truncated"), F.lit("").alias("note"))
    hits = triage_hits(issues, changed, floor, sources)
    pack = triage(issues, changed, floor, max_files, sources)
    none = hits.agg((F.count("*") == 0).alias("none")).scalar()
    if on_clean:
        pack = pack.unionByName(every.where(none).select("pack_file", "ord"))
    counts = hits.agg(F.count("*").alias("n_hits"), F.count_distinct(F.nullif("pack_file", F.lit(""))).alias("had"))
    n, had, clean = F.col("n_hits"), F.col("had"), F.col("n_hits") == 0
    note = F.when(clean, "no hit at the floor" + (": allowed all the same" if on_clean else ": bypassed")).when(had > max_files, F.concat(F.lit(f"pack cut to {max_files} of "), had)).otherwise("")
    return pack, counts.select((~clean | F.lit(on_clean)).alias("invoke"), (clean & F.lit(not on_clean)).alias("bypassed"), n, F.least(had, F.lit(max(1, max_files))).alias("n_files"), (had > max_files).alias("truncated"), note.alias("note"))


def select_entries(files: DataFrame, pack: DataFrame) -> DataFrame:
    """Files of the pack, in inventory order."""
    return files.join(pack.select("pack_file").distinct(), C.norm_route(files.relative) == F.col("pack_file"), "left_semi")


#: Rows of a group that are packed in one sorted pass; of a larger group only its last ones are, after rounds over all tasks.
FEW = 200_000
_END = (1 << 62) - 1


def _fold(rows: DataFrame, group: str) -> DataFrame:
    """Greedy packing in one pass: rows (group, ord, size, relative, room), sorted and batch by batch; what is held is a sum."""

    def fold(batches):
        now, used = object(), 0
        for pdf in batches:
            keep = []
            for g, size, room in zip(pdf[group].tolist(), pdf["size"].tolist(), pdf["room"].tolist(), strict=True):
                if g != now:
                    now, used = g, 0
                keep.append(used + size <= room)
                used += size if keep[-1] else 0
            yield pdf.loc[keep, [group, "ord", "size", "relative"]]

    return rows.repartition(group).sortWithinPartitions(group, "ord", "size", "relative").mapInPandas(fold, f"{group} string, ord long, size long, relative string")


def budget_pack(files: DataFrame, budget: int, group: str = "grp", few: int = FEW) -> DataFrame:
    """Greedy packing of each group in ord: a file over the remaining budget is left out, later smaller ones may fit.

    A group of up to `few` files is packed in one sorted pass. A larger one goes in rounds over a table in range partitions:
    with t the largest power of two up to the room left, every file of size t or less fits until the room falls below t, and
    at most one larger file fits before. The first such event is found from one sum a partition and a look into the partitions
    where it may lie; all smaller files before it are kept, and the room has halved. So there are as many rounds as the
    budget has bits at most, and a group whose last candidates are few is finished in one pass.
    """
    kind = {group: "string", "ord": "long", "size": "long"}
    d = files.where(F.col("size") <= budget).select(*[F.col(c).cast(t).alias(c) for c, t in kind.items()], "relative")
    large = d.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > few).select(F.col(group).alias("l_group"))
    if large.isEmpty():
        return _fold(d.withColumn("room", F.lit(budget).cast("long")), group)
    large = cut(large, "large_groups")
    by_group = lambda x, y, name: x.join(maybe_broadcast(y), x[group].eqNullSafe(F.col(name)), "left_semi")
    small = d.join(maybe_broadcast(large), d[group].eqNullSafe(F.col("l_group")), "left_anti").withColumn("room", F.lit(budget).cast("long"))
    table = ranged(by_group(d, large, "l_group"), F.col(group), F.col("ord"), F.col("size"), F.col("relative"))
    x = table.withColumn("pos", F.call_function("shiftleft", F.col("part").cast("long"), F.lit(PLACE)) + F.col("place"))
    state = large.select("l_group", F.lit(-1).cast("long").alias("at"), F.lit(budget).cast("long").alias("room"))
    kept, ends, made = [], [], [large]
    while True:
        t = F.when(F.col("room") > 0, F.expr("shiftleft(1L, length(bin(room)) - 1)")).otherwise(F.lit(0).cast("long"))
        c = x.join(maybe_broadcast(state.withColumn("t", t)), x[group].eqNullSafe(F.col("l_group"))).where((F.col("pos") > F.col("at")) & (F.col("size") <= F.col("room")))
        little = F.when(F.col("size") <= F.col("t"), F.col("size")).otherwise(F.lit(0).cast("long"))
        parts = cut(c.groupBy("l_group", "at", "room", "t", "part").agg(F.count("*").alias("n"), F.sum(little).alias("little"), F.min(F.when(F.col("size") > F.col("t"), F.col("size"))).alias("least")), "parts")
        made.append(parts)
        # groups with few candidates left are finished below
        w = Window.partitionBy("l_group").orderBy("part")
        p = parts.withColumns({"left": F.sum("n").over(Window.partitionBy("l_group")), "before": F.coalesce(F.sum("little").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))})
        ends.append(p.where(F.col("left") <= few).select("l_group", "at", "room").distinct())
        p = p.where(F.col("left") > few)
        if p.isEmpty():
            break
        # a partition may hold the event if its small files use the room up to t, or its least large file fits; none after the first that uses it up
        spent = F.col("before") + F.col("little") > F.col("room") - F.col("t")
        first = F.min(F.when(spent, F.col("part"))).over(Window.partitionBy("l_group"))
        p = p.withColumn("first", first).where((spent | (F.col("least") <= F.col("room") - F.col("before"))) & (F.col("first").isNull() | (F.col("part") <= F.col("first"))))
        look = p.select(F.col("l_group").alias("p_group"), F.col("part").alias("p_part"), "before")
        r = c.join(maybe_broadcast(look), F.col("l_group").eqNullSafe(F.col("p_group")) & (F.col("part") == F.col("p_part")))
        upto = F.col("before") + F.sum(little).over(Window.partitionBy("l_group", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        r = r.withColumn("upto", upto)
        event = F.when(F.col("size") <= F.col("t"), F.col("room") - F.col("upto") < F.col("t")).otherwise(F.col("size") <= F.col("room") - F.col("upto"))
        used = F.col("upto") + F.when(F.col("size") > F.col("t"), F.col("size")).otherwise(0)
        found = r.where(event).groupBy("l_group").agg(F.min_by(F.struct("pos", used.alias("used")), "pos").alias("e"))
        active = parts.groupBy("l_group", "at", "room", "t").agg(F.sum("n").alias("n")).where(F.col("n") > few)
        j = active.join(found.withColumnRenamed("l_group", "e_group"), active.l_group.eqNullSafe(F.col("e_group")), "left")
        step = cut(j.select("l_group", "at", "t", F.coalesce("e.pos", F.lit(_END)).alias("to"), (F.col("room") - F.col("e.used")).alias("room")), "steps")
        made.append(step)
        kept.append(step.select("l_group", "at", "t", "to"))
        state = step.where(F.col("to") < _END).select("l_group", F.col("to").alias("at"), "room")
    tail = reduce(DataFrame.unionByName, ends)
    rest = x.join(maybe_broadcast(tail), x[group].eqNullSafe(F.col("l_group"))).where((F.col("pos") > F.col("at")) & (F.col("size") <= F.col("room")))
    out = _fold(small.unionByName(rest.select(group, "ord", "size", "relative", "room")), group)
    if kept:
        runs = reduce(DataFrame.unionByName, kept)
        inside = (F.col("pos") > F.col("at")) & (F.col("pos") <= F.col("to")) & ((F.col("size") <= F.col("t")) | (F.col("pos") == F.col("to")))
        out = out.unionByName(x.join(maybe_broadcast(runs), x[group].eqNullSafe(F.col("l_group")) & inside).select(group, "ord", "size", "relative"))
    return last(out, "packed", table, *made)


def prefer(files: DataFrame, hot: DataFrame, adaptive: DataFrame) -> DataFrame:
    """files with a new ord: hot paths first, then adaptive ones, then the rest, each in its order. hot, adaptive: relative."""
    h, a = hot.select(F.col("relative").alias("h")).distinct(), adaptive.select(F.col("relative").alias("a")).distinct()
    j = files.join(h, files.relative == h.h, "left").join(a, files.relative == a.a, "left")
    rank = F.when(F.col("h").isNotNull(), 0).when(F.col("a").isNotNull(), 1).otherwise(2)
    return j.withColumn("lane", rank).drop("h", "a")


MODE_BANDS = {"review": ("p1", "p2", "p3"), "sentinel": ("p1",), "architecture": ("p3",)}


def deep_passes(rules: DataFrame, matrix: DataFrame, mode: str, full_audit: bool = False) -> DataFrame:
    """band, rule_ids, coverage_ids of the passes of a mode: bands with an enabled rule. rules: id, band, enabled; matrix: ord, id, rule_id, band, full_audit_only."""
    r = rules.where(F.col("enabled") & F.col("band").isin(*MODE_BANDS[mode]))
    m = matrix.where(F.lit(full_audit) | ~F.col("full_audit_only"))
    ids = m.join(r.select(F.col("id").alias("rule_id"), "band"), ["rule_id", "band"], "left_semi").groupBy("band").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x.getField("id")).alias("coverage_ids"))
    return r.groupBy("band").agg(F.array_sort(F.collect_list("id")).alias("rule_ids")).join(ids, "band", "left")


PLAYBOOKS = {"review": (("P1 security", "security"), ("P2 reliability", "reliability"), ("P3 architecture", "architecture")), "sentinel": (("P1 security", "security"),), "architecture": (("P3 architecture", "architecture"),)}
SCOPED = "Review the architecture of what changed and what depends on it. Give scores only where they are clearly warranted."


def playbooks(rules: DataFrame, mode: str, full_audit: bool = False) -> DataFrame:
    """ord, label, body of a mode's playbooks. A review without a full audit has a scoped text for architecture. rules: id, body."""
    rows = [(k, label, rule) for k, (label, rule) in enumerate(PLAYBOOKS[mode])]
    want = rules.sparkSession.createDataFrame(rows, "ord int, label string, id string")
    scoped = F.lit(mode == "review" and not full_audit) & (F.col("id") == "architecture")
    j = want.join(rules.select("id", "body"), "id", "left")
    return j.select("ord", F.when(scoped, F.concat("label", F.lit(" (scoped)"))).otherwise(F.col("label")).alias("label"), F.when(scoped, SCOPED).otherwise(F.col("body")).alias("body"))


def rules_with_overlays(defaults: DataFrame, user: DataFrame, project: DataFrame) -> DataFrame:
    """Rules (id, band, enabled, title, body) with a user's, then a project's values over them; unknown ids add nothing."""
    o = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "band", "enabled", "title", "body")])
    j = defaults.join(o(user, "u"), F.col("id") == F.col("u_id"), "left").join(o(project, "p"), F.col("id") == F.col("p_id"), "left")
    return j.select("id", *[F.coalesce(f"p_{c}", f"u_{c}", c).alias(c) for c in ("band", "enabled", "title", "body")])


def timeout_p95(runs: DataFrame, margin: float = 1.3, low: float = 120.0, high: float = 3600.0, last: int = 20) -> DataFrame:
    """Nearest-rank 95th percentile of the last ok runs' seconds times margin, within bounds. runs: id, outcome, llm_seconds."""
    recent = runs.where("outcome = 'ok' and llm_seconds is not null").orderBy(F.desc("id")).limit(last)
    return recent.agg(F.expr("percentile_disc(0.95) within group (order by llm_seconds)").alias("p")).select(F.greatest(F.lit(low), F.least(F.lit(high), F.col("p") * margin)).alias("timeout"))


def cold_timeout(n_files, low: float = 120.0, high: float = 3600.0):
    return F.least(F.lit(high), F.greatest(F.lit(low), 2.0 * n_files + 60))


def effective_timeout(explicit, recommended, local: bool, adaptive: bool = True):
    """Explicit, else recommended if adaptive, else the provider's default: 900 s local, 120 s otherwise."""
    return F.coalesce(explicit, recommended if adaptive else F.lit(None), F.lit(900.0 if local else 120.0))
