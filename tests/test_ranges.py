"""Corner sums, dyadic nodes, tiles and the lattice of marginals against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellview.catalog.base import LI3, lineitem_cells
from cellview.domain import Domain
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import ranges as R
from cellview.operators import workload as W
from cellview.operators.lattice import plan_lattice, roll_up
from cellview.plans import bisection as B
from cellview.plans import halving as H
from cellview.plans import settle as S


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*(np.asarray(c).tolist() for c in columns), strict=True)), schema)


def test_many_queries_on_one_set_and_one_wide_box(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 9, (40, 30))
    a, b = np.nonzero(dense)
    domain = Domain({"a": 40, "b": 30})
    cells = frame(spark, (a, b, dense[a, b]), "a int, b int, v bigint")
    n = 100_000
    lo, hi = (np.sort(rng.integers(0, d, (n, 2)), axis=1).T for d in (40, 30)), None
    (la, ha), (lb, hb) = lo
    queries = frame(spark, (range(n), la, ha, lb, hb), "query_id int, la int, ha int, lb int, hb int").selectExpr(
        "query_id", "inline(array(named_struct('attr', 'a', 'lo', la, 'hi', ha), named_struct('attr', 'b', 'lo', lb, 'hi', hb)))"
    )
    area = np.zeros((41, 31), int)
    area[1:, 1:] = dense.cumsum(0).cumsum(1)
    want = area[ha + 1, hb + 1] - area[la, hb + 1] - area[ha + 1, lb] + area[la, lb]
    got = C.answer_ranges(cells, queries, domain).select("query_id", "total").toPandas().set_index("query_id").total.sort_index().to_numpy()
    assert (got == want).all()
    wide = spark.createDataFrame([(0, 39, 0, 29, 0.5)], "lo_a int, hi_a int, lo_b int, hi_b int, value double")
    half = queries.where("query_id < 50000")
    est = A.view_range_count(wide, half, domain).toPandas().set_index("query_id").estimate.sort_index().to_numpy()
    assert np.allclose(est, 0.5 * (ha - la + 1)[:50_000] * (hb - lb + 1)[:50_000])


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_large_grids_meet_on_dyadic_nodes(spark, monkeypatch, node_rows):
    """Grids beyond a table: cells, boxes and queries over 5000 x 3000 x 7 codes, all nodes or one attribute's."""
    monkeypatch.setattr(R, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(2)
    domain = Domain({"a": 5000, "b": 3000, "c": 7})
    sizes = np.array([5000, 3000, 7])
    codes = np.unique((rng.random((300, 3)) * sizes).astype(int), axis=0)
    v = rng.integers(1, 50, len(codes))
    ends = np.sort((rng.random((60, 2, 3)) * sizes).astype(int), axis=1)
    rows = [(q, n, int(ends[q, 0, i]), int(ends[q, 1, i])) for q in range(60) for i, n in enumerate("abc") if i < 2 or q % 2]
    rows += [(60, "a", 10, 5), (61, None, 0, 0), (62, "c", 3, 99)]
    queries = spark.createDataFrame(rows, "query_id int, attr string, lo int, hi int")
    def bounds(q):
        mine = {n: (lo, hi) for i, n, lo, hi in rows if i == q}
        return [mine.get(n, (0, s - 1)) for n, s in zip("abc", sizes, strict=True)]
    want = {q: int(v[np.all([(codes[:, i] >= lo) & (codes[:, i] <= hi) for i, (lo, hi) in enumerate(bounds(q))], axis=0)].sum()) for q in range(63)}
    cells = frame(spark, (*codes.T, v), "a int, b int, c int, v bigint")
    assert {r.query_id: r.total for r in C.answer_ranges(cells, queries, domain).collect()} == want
    boxes = np.sort((rng.random((20, 2, 3)) * sizes).astype(int), axis=1)
    view = frame(spark, (*boxes[:, 0].T, *boxes[:, 1].T, np.arange(20) / 8), "lo_a int, lo_b int, lo_c int, hi_a int, hi_b int, hi_c int, value double")
    view = view.selectExpr("int(value * 8) % 2 AS trial", "*")
    got = {(r.trial, r.query_id): r.estimate for r in A.view_range_count(view, queries, domain, ["trial"]).collect()}
    assert len(got) == 126
    for (trial, q), e in got.items():
        total = 0.0
        for k in range(trial, 20, 2):
            cut = [min(boxes[k, 1, i], hi, sizes[i] - 1) - max(boxes[k, 0, i], lo) + 1 for i, (lo, hi) in enumerate(bounds(q))]
            total += k / 8 * math.prod(max(0, c) for c in cut)
        assert e == pytest.approx(total, rel=1e-6, abs=1e-2)


def test_eighty_attributes(spark):
    names = [f"a{i}" for i in range(80)]
    domain = Domain({n: 3 + i % 4 for i, n in enumerate(names)})
    codes = [[(7 * r * r + 3 * i * r + i) % domain[n] for i, n in enumerate(names)] for r in range(4)]
    cells = spark.createDataFrame([(*c, r + 1) for r, c in enumerate(codes)], ", ".join(f"{n} int" for n in names) + ", v bigint")
    queries = W.random_ranges(spark.range(200).withColumnRenamed("id", "query_id"), domain, 4, "w")
    asked = {}
    for r in queries.collect():
        asked.setdefault(r.query_id, []).append((names.index(r.attr), r.lo, r.hi))
    want = {q: sum(k + 1 for k, c in enumerate(codes) if all(lo <= c[i] <= hi for i, lo, hi in m)) for q, m in asked.items()}
    assert all(len(m) == 4 for m in asked.values())
    assert {r.query_id: r.total for r in C.answer_ranges(cells, queries, domain).collect()} == want


def test_ranks_are_the_sets_in_order(spark):
    domain = Domain({f"x{i}": i + 1 for i in range(7)})
    sets = list(itertools.combinations(domain.attrs, 3))
    got = spark.range(len(sets)).selectExpr("id", f"{W.unranked('id', domain, 3)} AS s").orderBy("id").collect()
    assert [tuple(x.attr for x in r.s) for r in got] == sets and got[-1].s[2].n == 7
    wide = Domain({f"x{i}": 2 for i in range(60)})
    last = spark.range(1).selectExpr(f"{W.unranked(str(math.comb(60, 4) - 1), wide, 4)} AS s").first()
    assert [x.attr for x in last.s] == ["x56", "x57", "x58", "x59"]
    with pytest.raises(ValueError):
        W.unranked("id", wide, 30)


@pytest.mark.parametrize("node_rows", [4096, 12])
def test_blocks_are_tiled(spark, sf, monkeypatch, node_rows):
    """Overlapping random blocks, single cells and the whole domain."""
    monkeypatch.setattr(R, "NODE_ROWS", node_rows)
    rng, sizes = np.random.default_rng(3), np.array(list(LI3.sizes.values()))
    ends = np.sort((rng.random((40, 2, 3)) * sizes).astype(int), axis=1)
    boxes = [(f"b{k}", *[int(x) for i in range(3) for x in (ends[k, 0, i], ends[k, 1, i])]) for k in range(40)]
    boxes += [("all", 0, 49, 0, 10, 0, 2), ("one", 7, 7, 3, 3, 1, 1)]
    cells = lineitem_cells(spark, sf)
    blocks = spark.createDataFrame(boxes, "block string, " + ", ".join(f"{r} int" for r in LI3.ranges()))
    got = sorted((r.block, r.q, r.d, r.r, r.v) for r in C.label_cells(cells, blocks, LI3, len(boxes)).collect())
    want = sorted((b, r.q, r.d, r.r, r.v) for r in cells.collect() for b, *e in boxes if all(e[2 * i] <= x <= e[2 * i + 1] for i, x in enumerate((r.q, r.d, r.r))))
    assert got == want


def test_lattice_derives_every_set_from_a_superset(spark):
    sizes = [50, 11, 3, 9, 2, 40, 7]
    sets = [s for k in (1, 2) for s in itertools.combinations(range(7), k)] + [()]
    rounds = plan_lattice(sets, sizes)
    by_number = {d.number: d for r in rounds for d in r}
    assert [by_number[k].attrs for k in range(len(sets))] == sets and len(rounds) > 1
    assert len(rounds[0]) < len(sets) / 2
    for level, r in enumerate(rounds):
        for d in r:
            assert (d.parent == -1) == (level == 0)
            assert d.parent < 0 or set(d.attrs) < set(by_number[d.parent].attrs) and by_number[d.parent] in rounds[level - 1]
    rng = np.random.default_rng(4)
    codes = (rng.random((500, 7)) * sizes).astype(int)
    cells = spark.createDataFrame([(c.tolist(), k) for k, c in enumerate(codes)], "codes array<int>, v bigint")
    got = {(r.sid, tuple(r.codes)): r.v for r in roll_up(cells, sets, sizes, ["v"]).collect()}
    want = {}
    for sid, s in enumerate(sets):
        for k, c in enumerate(codes):
            key = (sid, tuple(int(c[i]) for i in s))
            want[key] = want.get(key, 0) + k
    assert got == want


@pytest.mark.parametrize("limit", [9, -1])
def test_trees_are_the_same_however_they_grow(spark, sf, monkeypatch, limit):
    """Blocks finished in tasks or level by level, three trials together or one alone."""
    cells = lineitem_cells(spark, sf).where("q < 9 AND d < 5").persist()
    domain = Domain({"q": 9, "d": 5, "r": 3})
    columns = ["trial", "block", "depth", *domain.ranges(), "total", "size"]
    grow = {
        "bisection": lambda **kw: B.bisection_leaves(cells, domain, seed="g", max_depth=4, **kw),
        "halving": lambda **kw: H.halving_leaves(cells, domain, seed="g", cut_max=2, **kw),
    }
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    for name, run in grow.items():
        together = rows(run(trials=(0, 1, 7)))
        assert rows(run(trials=(7,))) == [r for r in together if r[0] == 7]
        with monkeypatch.context() as m:
            m.setattr(S, "SMALL_CELLS", limit)
            assert rows(run(trials=(0, 7))) == [r for r in together if r[0] != 1], name
    cells.unpersist()


def test_settle_rounds_like_the_columns(spark):
    x = [0.0078125, -0.0078125, 1.0000005, 2.5e-7, 5e-7, 123456.1234565, 8e12 + 0.0000305, -0.0, 3e15, 0.1234565]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    want = [r.y for r in df.select((F.round("x", 6) + F.lit(0.0)).alias("y")).collect()]
    assert S.settle(np.array(x)).tolist() == want
