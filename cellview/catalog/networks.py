"""Bayesian-network synthesis over grid codes of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellview.catalog.base import U, gumbel, laplace, query, settle, table
from cellview.functions import noise
from cellview.operators import discretize as Z
from cellview.operators import evaluate as E
from cellview.plans import network as N

Q = N.Hierarchy.numeric(4)
FLAG = N.Hierarchy.taxonomy([[0, 1, 2], [0, 2]])
NET3: N.Levels = {"q": Q, "t": Q, "r": FLAG}
NET5: N.Levels = {"q": Q, "d": Q, "r": FLAG, "t": Q, "s": N.Hierarchy.flat(2)}
RANGES = {"q": ("l_quantity", 1.0, 50.0), "d": ("l_discount", 0.0, 0.1), "t": ("l_tax", 0.0, 0.08)}
LABELS = {
    "r": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END",
    "s": "CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END",
}
EPS, THETA = 1.0, 4.0


def grid_records(spark, sf, levels):
    cols = []
    for a in levels:
        cols.append(Z.encode_grid(F.col(RANGES[a][0]), *RANGES[a][1:]).alias(a) if a in RANGES else F.expr(LABELS[a]).alias(a))
    return table(spark, sf, "lineitem").select(*cols)


def grid_cells(spark, sf, levels):
    return grid_records(spark, sf, levels).groupBy(*levels).agg(F.count(F.lit(1)).alias("v"))


def total(spark, sf) -> int:
    return table(spark, sf, "lineitem").count()


def grid_cells_sql(levels) -> str:
    cols = []
    for a in levels:
        if a in RANGES:
            c, lo, hi = RANGES[a]
            step = Z.grid_step(lo, hi) + 1e-8
            cols.append(f"greatest(0, least(CAST(floor(({c} - {lo!r}::DOUBLE) / {step!r}::DOUBLE) AS INTEGER), 15)) AS {a}")
        else:
            cols.append(f"{LABELS[a]} AS {a}")
    names = ", ".join(levels)
    return f"rec AS (SELECT {', '.join(cols)} FROM lineitem), cells AS (SELECT {names}, count(*) AS v FROM rec GROUP BY {names}), nn AS (SELECT count(*) AS n FROM lineitem)"


def lift_sql(levels, a: str, code: str, lvl: int) -> str:
    h = levels[a]
    if lvl == 0:
        return code
    if not h.uppers:
        return f"({code} // {2 ** lvl})"
    arms = " ".join(f"WHEN {code} <= {u} THEN {i}" for i, u in enumerate(h.uppers[lvl]))
    return f"(CASE {arms} END)"


def parent_key_sql(levels, a: str, code: str) -> str:
    arms = " ".join(f"WHEN {lvl} THEN {lift_sql(levels, a, code, lvl)}" for lvl in range(levels[a].depth))
    return f"CASE lv_{a} {arms} ELSE -1 END"


def width_sql(levels, a: str) -> str:
    arms = " ".join(f"WHEN {lvl} THEN {levels[a].sizes[lvl]}" for lvl in range(levels[a].depth))
    return f"CASE lv_{a} {arms} ELSE 1 END"


def size_case(levels, of) -> str:
    return "CASE child " + " ".join(f"WHEN '{a}' THEN {of(a)}" for a in levels) + " END"


def combos_sql(levels) -> str:
    """CTE ``combos``: every child with every choice of parent levels, and the
    width and bound that decide feasibility."""
    froms = ["(VALUES " + ", ".join(f"('{a}')" for a in levels) + ") c(child)"]
    for a in levels:
        froms.append("(VALUES " + ", ".join(f"({lvl})" for lvl in range(-1, levels[a].depth)) + f") x_{a}(lv_{a})")
    lvs = ", ".join(f"lv_{a}" for a in levels)
    name = "child || '<-' || concat_ws(',', " + ", ".join(f"CASE WHEN lv_{a} >= 0 THEN '{a}@' || lv_{a} END" for a in levels) + ")"
    width = " * ".join(f"({width_sql(levels, a)})::DOUBLE" for a in levels)
    child_size = size_case(levels, lambda a: levels[a].sizes[0])
    own = " AND ".join(f"(child <> '{a}' OR lv_{a} < 0)" for a in levels)
    d = len(levels)
    return f"""combos AS MATERIALIZED (SELECT {name} AS cand, child, {lvs}, {width} AS width,
      ({EPS}::DOUBLE * n / ({4.0 * d * THETA}::DOUBLE)) / ({child_size}) AS tau FROM {' CROSS JOIN '.join(froms)} CROSS JOIN nn WHERE {own})"""


def maximal_sql(levels, source: str) -> str:
    """Feasible rows of ``source`` that no other feasible row dominates."""
    fits = f"(SELECT * FROM {source} WHERE (tau < 1 AND {' AND '.join(f'lv_{a} < 0' for a in levels)}) OR (tau >= 1 AND width <= tau))"

    def rank(alias, a):
        return f"(CASE WHEN {alias}.lv_{a} < 0 THEN 0 ELSE {levels[a].depth} - {alias}.lv_{a} END)"

    at_least = " AND ".join(f"{rank('o', a)} >= {rank('f', a)}" for a in levels)
    return f"SELECT f.* FROM {fits} f WHERE NOT EXISTS (SELECT 1 FROM {fits} o WHERE o.child = f.child AND o.cand <> f.cand AND {at_least})"


PLACED, FREE = ["q", "d", "r"], ["t", "s"]
CANDS_SQL = f"""{grid_cells_sql(NET5)}, {combos_sql(NET5)}, eligible AS (SELECT * FROM combos WHERE child IN ('t', 's') AND lv_t < 0 AND lv_s < 0),
cands AS MATERIALIZED ({maximal_sql(NET5, 'eligible')})"""


def five_candidates(spark, sf):
    return N.parent_candidates(spark, PLACED, FREE, NET5, N.joint_bound(total(spark, sf), 5, EPS, THETA))


@query("bn_candidates", f"WITH {CANDS_SQL} SELECT cand, child, {', '.join(f'lv_{a}' for a in NET5)} FROM cands")
def bn_candidates(spark, sf):
    return five_candidates(spark, sf)


def joint_sql(levels, cands: str, name: str = "joint") -> str:
    keys = ", ".join(f"{parent_key_sql(levels, a, a)} AS p_{a}" for a in levels)
    return f"""{name} AS MATERIALIZED (SELECT cand, child, {keys}, {size_case(levels, lambda a: a)} AS x, CAST(sum(v) AS BIGINT) AS n
      FROM cells CROSS JOIN {cands} GROUP BY ALL)"""


@query("leveled_marginals", f"WITH {CANDS_SQL}, {joint_sql(NET5, 'cands')} SELECT * FROM joint")
def leveled_marginals(spark, sf):
    return N.leveled_marginals(grid_cells(spark, sf, NET5), five_candidates(spark, sf), NET5)


def margins_sql(levels, joint: str = "joint", tag: str = "") -> str:
    parents = ", ".join(["cand", *[f"p_{a}" for a in levels]])
    return f"""marg{tag} AS (SELECT *, n / nt::DOUBLE AS p, np / nt::DOUBLE AS pi, nx / nt::DOUBLE AS pj FROM (SELECT j.*, sum(j.n) OVER (PARTITION BY {parents}) AS np,
      sum(j.n) OVER (PARTITION BY cand, x) AS nx, nn.n AS nt FROM {joint} j CROSS JOIN nn))"""


# |p - pi pj| over all pairs: seen pairs, then the product mass of unseen pairs
L1 = settle("sum(abs(p - pi * pj)) + (1 - sum(pi * pj))")
INFO = settle("sum(p * log2(p / (pi * pj)))")


@query("score_l1_dependence", f"WITH {CANDS_SQL}, {joint_sql(NET5, 'cands')}, {margins_sql(NET5)} SELECT cand, child, {L1} AS score FROM marg GROUP BY cand, child")
def score_l1_dependence(spark, sf):
    cands = five_candidates(spark, sf)
    joint = N.leveled_marginals(grid_cells(spark, sf, NET5), cands, NET5)
    return N.dependence_scores(joint, NET5, total(spark, sf), 16 * cands.count())


@query("score_mutual_info", f"WITH {CANDS_SQL}, {joint_sql(NET5, 'cands')}, {margins_sql(NET5)} SELECT cand, child, {INFO} AS score FROM marg GROUP BY cand, child")
def score_mutual_info(spark, sf):
    cands = five_candidates(spark, sf)
    joint = N.leveled_marginals(grid_cells(spark, sf, NET5), cands, NET5)
    return N.information_scores(joint, NET5, total(spark, sf), 16 * cands.count())


# ------------------------------------------------------------------ the network


def structure_sql(levels, seed: str, trial: int = 0, source: str | None = None) -> str:
    """CTE ``model(step, cand, child, lv_*)``: greedy steps unrolled.

    ``source`` gives the CTEs ``cells`` and ``nn`` where they are not the grid codes.
    """
    d = len(levels)
    out = [source or grid_cells_sql(levels), combos_sql(levels), "fits AS (SELECT * FROM combos WHERE width <= greatest(tau, 1))",
           joint_sql(levels, "fits", "alljoint"), margins_sql(levels, "alljoint", "_all"),
           f"allscores AS MATERIALIZED (SELECT cand, {L1} AS score FROM marg_all GROUP BY cand)"]
    lvs = ", ".join(f"lv_{a}" for a in levels)
    for i in range(d):
        done = " UNION ALL ".join(f"SELECT child FROM m{j}" for j in range(i)) or "SELECT '' AS child"
        allowed = " AND ".join(f"(lv_{a} < 0 OR '{a}' IN (SELECT child FROM done{i}))" for a in levels)
        z = gumbel(f"'{seed}'", "'structure'", str(trial), str(i), "cand")
        if i:
            z = f"{0.5 * EPS / (d - 1)!r}::DOUBLE * score / (2::DOUBLE * (6.0::DOUBLE / n)) + {z}"
        out += [
            f"done{i} AS ({done})",
            f"e{i} AS (SELECT * FROM combos WHERE child NOT IN (SELECT child FROM done{i}) AND {allowed})",
            f"o{i} AS ({maximal_sql(levels, f'e{i}')})",
            f"m{i} AS MATERIALIZED (SELECT {i} AS step, cand, child, {lvs} FROM o{i} JOIN allscores USING (cand) CROSS JOIN nn ORDER BY {settle(z)} DESC LIMIT 1)",
        ]
    return ",\n".join(out) + ",\nmodel AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(d)) + ")"


SEED = "bn"
MODEL_SQL = structure_sql(NET5, SEED)


def learned(spark, sf):
    cells = grid_cells(spark, sf, NET5)
    return cells, N.learn_structure(cells, NET5, total(spark, sf), EPS, THETA, SEED)


@query(
    "bn_structure",
    f"""WITH {MODEL_SQL} SELECT step, child, concat_ws(',', {', '.join(f"CASE WHEN lv_{a} >= 0 THEN '{a}@' || lv_{a} END" for a in NET5)}) AS parents FROM model""",
)
def bn_structure(spark, sf):
    _, model = learned(spark, sf)
    return N.model_frame(spark, model).selectExpr(
        "step", "child", "concat_ws(',', transform(parents, p -> concat(p.col, '@', p.lvl))) AS parents"
    )


def families_sql(levels, seed: str = SEED, trial: int = 0) -> str:
    """CTE ``fam``: full noisy joint grid of every family."""
    grid, source = [], "model"
    for i, a in enumerate(levels):
        grid.append(f"g{i} AS (SELECT *, CAST(unnest(CASE WHEN lv_{a} < 0 THEN [-1] ELSE range(0, {width_sql(levels, a)}) END) AS INTEGER) AS p_{a} FROM {source})")
        source = f"g{i}"
    keys = ["cand", "child", *[f"p_{a}" for a in levels], "x"]
    d = len(levels)
    draw = laplace(2.0 * d / (0.5 * EPS), f"'{seed}'", "'family'", str(trial), *keys[1:])
    return f"""{', '.join(grid)}, gx AS (SELECT *, CAST(unnest(range(0, {size_case(levels, lambda a: levels[a].sizes[0])})) AS INTEGER) AS x FROM {source}),
    {joint_sql(levels, 'model', 'famjoint')},
    fam AS MATERIALIZED (SELECT {', '.join('g.' + k for k in keys)}, coalesce(j.n, 0) AS n, {settle(f'coalesce(j.n, 0) + ' + draw.replace(', child', ', g.child').replace(', p_', ', g.p_').replace(', x)', ', g.x)'))} AS y
      FROM gx g LEFT JOIN famjoint j USING ({', '.join(keys)}))"""


FAM_SQL = f"{MODEL_SQL},\n{families_sql(NET5)}"


@query("bn_noisy_marginals", f"WITH {FAM_SQL} SELECT * FROM fam")
def bn_noisy_marginals(spark, sf):
    cells, model = learned(spark, sf)
    return N.noisy_families(cells, model, NET5, EPS, SEED)


def conditionals_sql(levels) -> str:
    """CTE ``cond``: cumulative distribution of the child per parent cell."""
    key = "cand, child, " + ", ".join(f"p_{a}" for a in levels)
    return f"""w1 AS (SELECT *, greatest(y, 0) AS w, sum(greatest(y, 0)) OVER (PARTITION BY {key}) AS t FROM fam),
w2 AS (SELECT {key}, x, CASE WHEN t > 0 THEN w ELSE 1 END AS w FROM w1),
w3 AS (SELECT *, sum(w) OVER (PARTITION BY {key}) AS t, sum(w) OVER (PARTITION BY {key} ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM w2),
cond AS MATERIALIZED (SELECT {key}, x, {settle('(c - w) / t', 9)} AS cdf_lo, {settle('c / t', 9)} AS cdf_hi FROM w3)"""


COND_SQL = conditionals_sql(NET5)


@query("bn_conditional", f"WITH {FAM_SQL}, {COND_SQL} SELECT * FROM cond")
def bn_conditional(spark, sf):
    cells, model = learned(spark, sf)
    return N.conditionals(N.noisy_families(cells, model, NET5, EPS, SEED), NET5)


def sampling_sql(levels, seed: str = SEED, trial: int = 0, rows: str = "orders", key: str = "o_orderkey") -> str:
    """CTE ``s<attributes>``: one synthetic record per row of ``rows``."""
    out = [f"s0 AS (SELECT {key}, {', '.join(f'CAST(NULL AS INTEGER) AS {a}' for a in levels)} FROM {rows})"]
    for i in range(len(levels)):
        keys = ", ".join(f"{parent_key_sql(levels, a, a)} AS p_{a}" for a in levels)
        on = " AND ".join(f"c.p_{a} = k.p_{a}" for a in levels)
        put = ", ".join(f"CASE WHEN k.child = '{a}' THEN c.x ELSE k.{a} END AS {a}" for a in levels)
        u = U(f"'{seed}'", "'record'", str(trial), "child", key)
        out += [
            f"k{i} AS (SELECT s.*, child, {keys}, round({u}, 9) AS u FROM s{i} s CROSS JOIN m{i})",
            f"s{i + 1} AS MATERIALIZED (SELECT {key}, {put} FROM k{i} k JOIN cond c ON c.child = k.child AND {on} AND k.u >= c.cdf_lo AND k.u < c.cdf_hi)",
        ]
    return ",\n".join(out)


@query("bn_sample", f"WITH {FAM_SQL}, {COND_SQL}, {sampling_sql(NET5)} SELECT o_orderkey, {', '.join(NET5)} FROM s5")
def bn_sample(spark, sf):
    cells, model = learned(spark, sf)
    families = N.noisy_families(cells, model, NET5, EPS, SEED)
    rows = table(spark, sf, "orders").select("o_orderkey")
    return N.ancestral_sample(rows, "o_orderkey", N.conditionals(families, NET5), model, NET5, SEED)


@query(
    "bn_decode",
    f"""WITH {FAM_SQL}, {COND_SQL}, {sampling_sql(NET5)} SELECT o_orderkey, round((q + 0.5::DOUBLE) * 3.0625::DOUBLE + 1, 6) AS quantity, round((t + 0.5::DOUBLE) * 0.005::DOUBLE, 6) AS tax,
    round((d + 0.5::DOUBLE) * 0.00625::DOUBLE, 6) AS discount, CASE r WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS flag,
    CASE s WHEN 0 THEN 'F' ELSE 'O' END AS status FROM s5""",
)
def bn_decode(spark, sf):
    tax = spark.createDataFrame([("A", 0, 0, 0), ("N", 1, 0, 1), ("R", 2, 0, 2)], "value string, code int, lvl int, segment int")
    status = spark.createDataFrame([("F", 0, 0, 0), ("O", 1, 0, 1)], "value string, code int, lvl int, segment int")
    coded = bn_sample(spark, sf).select(
        "o_orderkey",
        F.round(Z.decode_grid(F.col("q"), 1.0, 50.0), 6).alias("quantity"),
        F.round(Z.decode_grid(F.col("t"), 0.0, 0.08), 6).alias("tax"),
        F.round(Z.decode_grid(F.col("d"), 0.0, 0.1), 6).alias("discount"),
        F.col("r").alias("flag"), F.col("s").alias("status"),
    )
    return Z.decode_taxonomy(Z.decode_taxonomy(coded, "flag", tax), "status", status)


@query(
    "model_mutual_info",
    f"""WITH {MODEL_SQL}, {joint_sql(NET5, 'model', 'famjoint')}, {margins_sql(NET5, 'famjoint', '_fam')},
    s AS (SELECT cand, {INFO} AS score FROM marg_fam GROUP BY cand) SELECT count(*) AS families, {settle('sum(score)')} AS mutual_info FROM s""",
)
def model_mutual_info(spark, sf):
    cells, model = learned(spark, sf)
    return E.model_information(cells, model, NET5, total(spark, sf))
