"""Product codes against plain search, and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from cellview.llm.vector_codes import LONGEST, Codebook, ProductCode, compress


def brute(vectors, plan):
    """{id: (code, error)} by comparing every part with every entry; vectors: [(id, [x])]."""
    whole = [(i, [int(np.floor(plan.scale * x)) for x in v]) for i, v in sorted(vectors, key=lambda r: r[0])]
    k = len(whole[0][1]) // plan.parts
    cut = lambda v, p: v[p * k : (p + 1) * k]
    books = [[cut(v, p) for _, v in whole[: plan.entries]] for p in range(plan.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(plan.parts)] for _, v in whole]
    for _ in range(plan.rounds):
        for p in range(plan.parts):
            found = [min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))[1] for _, v in whole]
            for e in set(found):
                mine = [cut(v, p) for (_, v), f in zip(whole, found, strict=True) if f == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return {i: ("".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for (i, _), a in zip(whole, assign(), strict=True)}


def test_equal_average_search_with_ties():
    rng = np.random.default_rng(1)
    for _ in range(30):
        entries = rng.integers(-3, 4, (40, 4)).tolist()
        parts = rng.integers(-4, 5, (200, 4))
        got, far = Codebook(entries).nearest(parts)
        d = ((parts[:, None, :] - np.array(entries)[None]) ** 2).sum(-1)
        assert (got == d.argmin(1)).all() and (far == d.min(1)).all()


def test_codes_equal_plain_search(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.02, 8)], int(i) % 3) for i in range(300)]
    plan = ProductCode(parts=4, entries=8)
    want = brute([(i, v) for i, v, _ in rows], plan)
    got = {r.vec_id: r for r in compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), plan).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    for label in range(3):
        assert {r.label_error for r in got.values() if r.label == label} == {sum(want[i][1] for i, _, x in rows if x == label)}


def test_odd_vectors(spark):
    one = [0.5, -0.5, 0.25, 0.0]
    rows = [
        (1, one, 1), (1, one, 1), (2, None, 1), (3, [float("nan")] * 4, 1), (4, [None] * 4, 1), (5, [float("inf")] * 4, 1), (6, [1.0], 1), (7, [], None),
        (None, one, None), (8, [1e300, -1e300, 0.0, 0.0], None), (9, one, 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("code", F.lit(1)).withColumn("v", F.lit(2)).withColumn("known", F.lit(3)).withColumn("n", F.lit(0))
    got = compress(df, ProductCode(parts=2, entries=2, rounds=0)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.vec_id is not None) == [(False, i) for i in (1, 1, 6, 7, 8, 9)]
    by = {r.vec_id: r for r in got}
    assert by[1].error == 0 and by[6].code is None and by[7].error is None and by[8].error == LONGEST and by[None].error == 0
    assert by[None].label_error == by[8].label_error == LONGEST and by[1].label_error == 0
    assert all(r.error in (0, None) for r in compress(df, ProductCode(parts=2, entries=3)).collect())
    assert compress(df.where("false")).count() == 0
