"""Global numbers, running sums and greedy packing over range partitions, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import ordered, planning


def test_numbers_and_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "c", None]), r.randint(0, 50), k, r.randint(0, 9)) for k in range(500)]
    d = spark.createDataFrame(rows, "g string, x int, k int, size long").repartition(7)
    order = [F.col("g"), F.col("x"), F.col("k")]
    want = sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", t[1], t[2]))
    got = ordered.numbered(d, *order, partitions=5)
    assert got.columns == ["g", "x", "k", "size", "ord"]
    assert [tuple(x)[:4] for x in got.orderBy("ord").collect()] == want and sorted(x.ord for x in got.collect()) == list(range(500))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 1  # over one row for each partition
    sums, seen = {}, {}
    for g, _, k, size in want:
        sums[g] = sums.get(g, 0) + size
        seen[k] = sums[g]
    run = ordered.running(ordered.ranged(d, *order, partitions=6), F.col("size"), "g")
    assert {x.k: x.upto for x in run.collect()} == seen
    assert ordered.numbered(d.where("false"), *order).count() == 0


def greedy(rows, budget):
    used, out = {}, set()
    for g, ord_, size, path in sorted((x for x in rows if x[2] is not None), key=lambda t: (t[0] is not None, t[0] or "", t[1], t[2], t[3])):
        if used.get(g, 0) + size <= budget:
            used[g] = used.get(g, 0) + size
            out.add((g, ord_, size, path))
    return out


SIZES = {
    "mixed": lambda r, k: r.choice([0, 1, 3, 10, 40, 90, 200, 999]),
    "falling": lambda r, k: 1 if k % 2 == 0 else max(1, 500 - k // 2),
    "zeros": lambda r, k: 0 if k % 3 else 500,
    "large": lambda r, k: r.randint(250, 600),
}


@pytest.mark.parametrize("kind", SIZES)
def test_packing_in_rounds_equals_the_greedy_loop(spark, kind):
    r = random.Random(5)
    rows = [(r.choice(["one", "one", "one", "two", None]), k, SIZES[kind](r, k), f"f{k}") for k in range(600)] + [("one", 700, None, "n"), ("few", 1, 5, "p"), ("few", 1, 5, "q")]
    d = spark.createDataFrame(rows, "grp string, ord long, size long, relative string").repartition(3)
    for budget in (511, 0) if kind == "mixed" else (500,):
        got = {tuple(x) for x in planning.budget_pack(d, budget, few=20).collect()}
        assert got == greedy(rows, budget), (kind, budget)
        assert {tuple(x) for x in planning.budget_pack(d, budget).collect()} == got


def test_packing_leaves_the_tail_of_a_large_group_to_one_pass(spark):
    rows = [("g", k, 1 + k % 5, f"f{k}") for k in range(400)]
    d = spark.createDataFrame(rows, "grp string, ord long, size long, relative string")
    assert {tuple(x) for x in planning.budget_pack(d, 900, few=0).collect()} == greedy(rows, 900)
    assert planning.budget_pack(d.where("false"), 900, few=0).count() == 0
