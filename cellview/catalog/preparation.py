"""Sources, cleaning, discretization, sampling and generators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellview.catalog.base import KEYS, LI3, LI5, LI_SQL, U, laplace, lineitem_codes, query, settle, table, uniform_int
from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators import clean as K
from cellview.operators import discretize as Z
from cellview.plans.network import Hierarchy
from cellview.session import fresh_path
from cellview.sources import generate as G
from cellview.sources import sampling as S
from cellview.sources import tables as T

# -------------------------------------------------------------- sources, sinks


@query("load_table", f"WITH {LI_SQL} SELECT q, d, r FROM li")
def load_table(spark, sf):
    path = fresh_path(spark, "codes")
    lineitem_codes(spark, sf).write.parquet(path)
    return T.load_table(spark, path, LI3)


@query(
    "read_delimited",
    """SELECT sep, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    CROSS JOIN (VALUES ('comma'), ('tab'), ('blank')) AS s(sep)""",
)
def read_delimited(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    rows, out = table(spark, sf, "lineitem").select(*cols), None
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
    for name, sep, header in (("comma", ",", True), ("tab", "\t", False), ("blank", " ", False)):
        path = fresh_path(spark, name)
        T.write_delimited(rows, path, sep, header)
        part = T.read_delimited(spark, path, schema, sep, header).select(F.lit(name).alias("sep"), *cols)
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "write_dataset",
    f"""WITH {LI_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {U("'w'", "'split'", 'l_orderkey', 'l_linenumber')},
    l_orderkey, l_linenumber) AS rn, count(*) OVER () AS n FROM li)
    SELECT q, d, r, CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ranked""",
)
def write_dataset(spark, sf):
    root, codes = fresh_path(spark, "dataset"), lineitem_codes(spark, sf)
    raw = table(spark, sf, "lineitem").select(*KEYS, "l_quantity", "l_discount", "l_returnflag")
    T.write_dataset(root, codes.select(*KEYS, *LI3.attrs), raw, LI3, KEYS, "w")
    domain = T.read_domain(spark, f"{root}/domain")
    return spark.read.parquet(f"{root}/data_parts").select(*domain.attrs, "part")


@query(
    "export_libsvm",
    f"""WITH {LI_SQL} SELECT (CASE WHEN s IN (1) THEN '+1' ELSE '-1' END) || ' 1:' || printf('%.6f', (q + 0.5::DOUBLE) / 3.125::DOUBLE / 16)
    || ' ' || (d + 2) || ':1 ' || (r + 13) || ':1' AS value FROM li""",
)
def export_libsvm(spark, sf):
    levels = {"q": Hierarchy.numeric(4), "d": Hierarchy.flat(11), "r": Hierarchy.flat(3), "s": Hierarchy.flat(2)}
    path = fresh_path(spark, "libsvm")
    codes = lineitem_codes(spark, sf)
    T.export_libsvm(codes.select("q", "d", "r", "s"), levels, "s", [1], path, raw={"q": (-0.5, 49.5)})
    return spark.read.text(path)


@query(
    "export_libsvm_sampled",
    f"""WITH {LI_SQL} SELECT (CASE WHEN s IN (1) THEN '+1' ELSE '-1' END) || ' 1:'
    || printf('%.6f', (q - 0::DOUBLE) / 3.0625::DOUBLE / 16) || ' ' || (r + 2) || ':1' AS value FROM li
    WHERE {U("'x'", "'keep'", 'l_orderkey', 'l_linenumber')} <= 0.25::DOUBLE""",
)
def export_libsvm_sampled(spark, sf):
    levels = {"q": Hierarchy.numeric(4), "r": Hierarchy.flat(3), "s": Hierarchy.flat(2)}
    kept = T.keep_ratio(lineitem_codes(spark, sf), 0.25, KEYS, "x")
    path = fresh_path(spark, "libsvm")
    T.export_libsvm(kept.select("q", "r", "s"), levels, "s", [1], path, raw={"q": (0.0, 49.0)})
    return spark.read.text(path)


# -------------------------------------------------------------------- cleaning


@query("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_columns(spark, sf):
    return K.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@query("trim_strings", "SELECT doc_id, trim('  ' || lang || ' ') AS lang, trim(' ' || source) AS source FROM documents")
def trim_strings(spark, sf):
    padded = table(spark, sf, "documents").selectExpr("doc_id", "concat('  ', lang, ' ') AS lang", "concat(' ', source) AS source")
    return K.trim_strings(padded)


@query(
    "recode_values",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'half' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE 'black' END AS o_orderpriority FROM orders""",
)
def recode_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fixed = K.recode(orders, "o_orderstatus", {"F": "done", "P": "half"})
    return K.recode(fixed, "o_orderpriority", {"1-URGENT": "1-URGENT"}, otherwise="black")


@query(
    "union_parts",
    "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def union_parts(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal AS balance")
    b = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return K.union_parts(a, b)


HOLES = "CASE WHEN l_discount = 0 THEN NULL ELSE l_tax END"


@query("drop_nulls", f"SELECT l_orderkey, l_linenumber, {HOLES} AS tax FROM lineitem WHERE {HOLES} IS NOT NULL")
def drop_nulls(spark, sf):
    return K.drop_nulls(table(spark, sf, "lineitem").selectExpr(*KEYS, f"{HOLES} AS tax"))


MARKED = "CASE WHEN l_discount = 0 THEN '?' ELSE CAST(l_quantity AS {0}) END"


@query(
    "filter_sentinel",
    "SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem WHERE l_discount <> 0",
)
def filter_sentinel(spark, sf):
    marked = table(spark, sf, "lineitem").selectExpr(*KEYS, f"{MARKED.format('STRING')} AS quantity")
    return K.filter_sentinel(marked, ["quantity"])


@query("filter_range_predicate", "SELECT event_id, event_type, value FROM events WHERE value <= 90")
def filter_range_predicate(spark, sf):
    return table(spark, sf, "events").filter("value <= 90").select("event_id", "event_type", "value")


@query(
    "timestamp_to_epoch",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS plain, CAST(floor(epoch(ts)) AS BIGINT) AS zulu FROM events",
)
def timestamp_to_epoch(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("a"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"),
    )
    return text.select(
        "event_id",
        K.parse_epoch(F.col("a"), "yyyy-MM-dd HH:mm:ss").alias("plain"),
        K.parse_epoch(F.col("b"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("zulu"),
    )


@query(
    "dense_code",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_retailprice) - 1 AS INTEGER) AS p_retailprice FROM part",
)
def dense_code(spark, sf):
    return K.dense_code(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("replace_chars", "SELECT event_id, replace(props, ' ', '-') AS props FROM events")
def replace_chars(spark, sf):
    return K.replace_chars(table(spark, sf, "events").select("event_id", "props"), "props", " ", "-")


@query("format_fixed6", "SELECT o_orderkey, printf('%.6f', o_totalprice) AS price FROM orders")
def format_fixed6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", K.fixed6(F.col("o_totalprice")).alias("price"))


@query("rename_columns", "SELECT doc_id AS a, quality AS b, toxic AS c FROM labels")
def rename_columns(spark, sf):
    return K.rename_columns(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["a", "b", "c"])


# -------------------------------------------------------------- discretization

MIXED = ["c_mktsegment", "c_nationkey", "c_acctbal"]


@query(
    "fit_domain",
    """SELECT 'c_mktsegment' AS attr, 'category' AS kind, count(DISTINCT c_mktsegment) AS size FROM customer
    UNION ALL SELECT 'c_nationkey', CASE WHEN max(c_nationkey) - min(c_nationkey) <= 100 THEN 'offset' ELSE 'width' END,
      CASE WHEN max(c_nationkey) - min(c_nationkey) <= 100 THEN max(c_nationkey) - min(c_nationkey) + 1 ELSE 100 END FROM customer
    UNION ALL SELECT 'c_acctbal', 'width', 100""",
)
def fit_domain(spark, sf):
    return Z.fit_domain(table(spark, sf, "customer").select(*MIXED), 100)


@query(
    "discretize_categorical",
    """WITH dict AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_name AS v FROM part))
    SELECT p_partkey, code AS p_name FROM part JOIN dict ON v = p_name""",
)
def discretize_categorical(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return Z.apply_codes(parts, Z.fit(parts.select("p_name"), 100), parts)


@query(
    "discretize_int_offset",
    "SELECT p_partkey, p_size - (SELECT min(p_size) FROM part) AS p_size FROM part",
)
def discretize_int_offset(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return Z.apply_codes(parts, Z.fit(parts.select("p_size"), 100), parts)


def width_sql(c: str, source: str, limit: int = 100) -> str:
    lo, hi = f"(SELECT min({c}) FROM {source})", f"(SELECT max({c}) FROM {source})"
    code = f"CAST(floor({limit}::DOUBLE * ({c} - {lo}) / ({hi} + 0.1::DOUBLE - {lo})) AS INTEGER)"
    return f"greatest(0, least({code}, {limit - 1}))"


@query(
    "discretize_equal_width",
    f"SELECT l_orderkey, l_linenumber, {width_sql('l_extendedprice', 'lineitem')} AS l_extendedprice FROM lineitem",
)
def discretize_equal_width(spark, sf):
    rows = table(spark, sf, "lineitem").select(*KEYS, "l_extendedprice")
    return Z.apply_codes(rows, Z.fit(rows.select("l_extendedprice"), 100), rows)


@query(
    "discretize_table",
    f"""WITH dict AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))
    SELECT code AS c_mktsegment, c_nationkey - (SELECT min(c_nationkey) FROM customer) AS c_nationkey,
    {width_sql('c_acctbal', 'customer')} AS c_acctbal FROM customer JOIN dict ON v = c_mktsegment""",
)
def discretize_table(spark, sf):
    codes, _ = Z.discretize(table(spark, sf, "customer").select(*MIXED), 100)
    return codes


@query(
    "apply_discretizer",
    f"""WITH dict AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_nationkey AS v FROM customer)),
    b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    SELECT s_suppkey, code AS nation, greatest(0, least(CAST(floor(100::DOUBLE * (s_acctbal - lo) / (hi + 0.1::DOUBLE - lo)) AS INTEGER), 99)) AS balance
    FROM supplier CROSS JOIN b LEFT JOIN dict ON v = s_nationkey""",
)
def apply_discretizer(spark, sf):
    source = table(spark, sf, "customer").selectExpr("string(c_nationkey) AS nation", "c_acctbal AS balance")
    # two-digit text keeps byte order equal to numeric order
    source = source.withColumn("nation", F.lpad("nation", 2, "0"))
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", "lpad(string(s_nationkey), 2, '0') AS nation", "s_acctbal AS balance")
    return Z.apply_codes(rows, Z.fit(source, 100), source)


PRICE = (0.0, 600000.0)


def grid_sql(c: str, low: float, high: float) -> str:
    step = Z.grid_step(low, high) + 1e-8
    return f"greatest(0, least(CAST(floor(({c} - {low}::DOUBLE) / {step!r}::DOUBLE) AS INTEGER), 15))"


@query("encode_grid", f"SELECT o_orderkey, {grid_sql('o_totalprice', *PRICE)} AS code FROM orders")
def encode_grid(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", Z.encode_grid(F.col("o_totalprice"), *PRICE).alias("code"))


@query(
    "decode_grid",
    f"SELECT o_orderkey, ({grid_sql('o_totalprice', *PRICE)} + 0.5::DOUBLE) * 37500::DOUBLE + 0::DOUBLE AS price FROM orders",
)
def decode_grid(spark, sf):
    code = Z.encode_grid(F.col("o_totalprice"), *PRICE)
    return table(spark, sf, "orders").select("o_orderkey", Z.decode_grid(code, *PRICE).alias("price"))


TAX_SQL = """leaf AS (SELECT n_nationkey, n_name AS value, n_regionkey,
    CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INTEGER) AS code FROM nation),
    tax AS (SELECT value, code, 0 AS lvl, code AS segment, n_nationkey FROM leaf
    UNION ALL SELECT value, code, 1, n_regionkey, n_nationkey FROM leaf)"""


def nation_taxonomy(spark, sf):
    """nation -> region as a declared two-level taxonomy (one row per nation and level)."""
    nations = table(spark, sf, "nation")
    ordered = nations.agg(F.expr("array_sort(collect_list(struct(n_regionkey, n_nationkey, n_name)))").alias("o"))
    leaf = ordered.select(F.posexplode("o").alias("code", "n")).selectExpr("code", "n.*")
    return leaf.selectExpr(
        "n_name AS value", "code", "n_nationkey",
        "inline(array(struct(0 AS lvl, code AS segment), struct(1 AS lvl, n_regionkey AS segment)))",
    )


def customer_nation(spark, sf):
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


CUST_SQL = "cn AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("encode_taxonomy", f"WITH {TAX_SQL}, {CUST_SQL} SELECT c_custkey, code AS n_name FROM cn JOIN tax ON value = n_name WHERE lvl = 0")
def encode_taxonomy(spark, sf):
    return Z.encode_taxonomy(customer_nation(spark, sf), "n_name", nation_taxonomy(spark, sf))


@query("decode_taxonomy", f"WITH {CUST_SQL} SELECT c_custkey, n_name FROM cn")
def decode_taxonomy(spark, sf):
    tax = nation_taxonomy(spark, sf)
    return Z.decode_taxonomy(Z.encode_taxonomy(customer_nation(spark, sf), "n_name", tax), "n_name", tax)


@query(
    "generalize",
    f"""WITH {TAX_SQL}, {CUST_SQL} SELECT c_custkey, t.segment AS region, {grid_sql('c_acctbal', -1000.0, 10000.0)} // 4 AS balance
    FROM customer JOIN tax t ON t.n_nationkey = c_nationkey WHERE lvl = 1""",
)
def generalize(spark, sf):
    tax = nation_taxonomy(spark, sf)
    coded = Z.encode_taxonomy(customer_nation(spark, sf), "n_name", tax)
    lifted = Z.generalize_taxonomy(coded, "n_name", 1, tax).withColumnRenamed("n_name", "region")
    balance = Z.generalize_grid(Z.encode_grid(F.col("c_acctbal"), -1000.0, 10000.0), 2)
    return lifted.join(table(spark, sf, "customer").select("c_custkey", balance.alias("balance")), "c_custkey")


@query(
    "specialize",
    f"""WITH {TAX_SQL} SELECT 'taxonomy' AS kind, lvl, segment, min(code) AS first, max(code) + 1 AS past FROM tax GROUP BY lvl, segment
    UNION ALL SELECT DISTINCT 'grid', 2, {grid_sql('o_totalprice', *PRICE)} // 4, ({grid_sql('o_totalprice', *PRICE)} // 4) * 4,
    ({grid_sql('o_totalprice', *PRICE)} // 4 + 1) * 4 FROM orders""",
)
def specialize(spark, sf):
    tax = Z.specialize_taxonomy(nation_taxonomy(spark, sf)).select(
        F.lit("taxonomy").alias("kind"), "lvl", "segment", "first", "past"
    )
    code = Z.generalize_grid(Z.encode_grid(F.col("o_totalprice"), *PRICE), 2)
    seen = table(spark, sf, "orders").select(code.alias("segment")).distinct()
    first, past = Z.specialize_grid(F.col("segment"), 2)
    return tax.unionByName(seen.select(F.lit("grid").alias("kind"), F.lit(2).alias("lvl"), "segment", first.alias("first"), past.alias("past")))


# ---------------------------------------------------- samples, splits, generators


@query(
    "train_test_split",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {U("'7'", "'split'", 'l_orderkey', 'l_linenumber')},
    l_orderkey, l_linenumber) AS rn, count(*) OVER () AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def train_test_split(spark, sf):
    return S.train_test_split(table(spark, sf, "lineitem").select(*KEYS), KEYS, "7")


@query(
    "sample_n",
    f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    ORDER BY {U("'7'", "'sample'", 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 5000""",
)
def sample_n(spark, sf):
    return S.sample_n(table(spark, sf, "lineitem").select(*KEYS, "l_quantity"), 5000, KEYS, "7")


@query(
    "gen_uniform",
    f"""SELECT l_orderkey, l_linenumber, {', '.join(f"{uniform_int('0', str(n), chr(39) + 'g' + chr(39), chr(39) + 'uniform' + chr(39), chr(39) + a + chr(39), 'l_orderkey', 'l_linenumber')} AS {a}" for a, n in LI3.sizes.items())} FROM lineitem""",
)
def gen_uniform(spark, sf):
    return G.uniform_codes(table(spark, sf, "lineitem").select(*KEYS), KEYS, LI3, "g")


def geometric_sql(p: float, *parts: str) -> str:
    return f"CAST(floor(ln(1::DOUBLE - {U(*parts)}) / ({math.log(1 - p)!r}::DOUBLE)) AS BIGINT)"


def gaussian_sql(*parts: str) -> str:
    return settle(
        f"0::DOUBLE + 1::DOUBLE * sqrt(-2::DOUBLE * ln({U(*parts, chr(39) + 'radius' + chr(39))})) * cos({2 * math.pi!r}::DOUBLE * {U(*parts, chr(39) + 'angle' + chr(39))})"
    )


def edges_sql(x: str, n: int, source: str) -> str:
    lo, hi = f"(SELECT min({x}) FROM {source})", f"(SELECT max({x}) FROM {source})"
    return f"greatest(0, least(CAST(floor(round(({x} - {lo}) / (({hi} - {lo}) / {n - 1}::DOUBLE), 9)) AS INTEGER), {n - 1}))"


EV = "'e'", "'geometric'", "'x'", "event_id"


@query(
    "gen_geometric",
    f"WITH raw AS (SELECT event_id, CAST({geometric_sql(0.05, *EV)} + 1 AS DOUBLE) AS x FROM events) SELECT event_id, {edges_sql('x', 10, 'raw')} AS x FROM raw",
)
def gen_geometric(spark, sf):
    return G.generate_table(table(spark, sf, "events").select("event_id"), ["event_id"], {"x": G.Spec(10, "geometric")}, "e")


@query(
    "gen_gauss",
    f"""WITH raw AS (SELECT event_id, {gaussian_sql("'e'", "'gauss'", "'x'", 'event_id')} AS x FROM events)
    SELECT event_id, {edges_sql('x', 10, 'raw')} AS x FROM raw""",
)
def gen_gauss(spark, sf):
    return G.generate_table(table(spark, sf, "events").select("event_id"), ["event_id"], {"x": G.Spec(10, "gauss")}, "e")


def permutation_sql(attr: str, n: int, seed: str, name: str = "perm") -> str:
    return f"""{name} AS (SELECT code, CAST(row_number() OVER (ORDER BY {U(f"'{seed}'", "'permute'", f"'{attr}'", 'code')}, code) - 1 AS INTEGER) AS other
    FROM (SELECT CAST(range AS INTEGER) AS code FROM range({n})))"""


@query("permute_codes", f"WITH {LI_SQL}, {permutation_sql('q', 50, 'p')} SELECT l_orderkey, l_linenumber, other AS q FROM li JOIN perm ON code = q")
def permute_codes(spark, sf):
    return G.permute_codes(lineitem_codes(spark, sf).select(*KEYS, "q"), "q", 50, "p")


@query(
    "gen_table",
    f"""WITH raw AS (SELECT event_id, {uniform_int('0', '12', "'e'", "'uniform'", "'a'", 'event_id')} AS a,
      CAST({geometric_sql(0.2, "'e'", "'geometric'", "'b'", 'event_id')} + 1 AS DOUBLE) AS b, {gaussian_sql("'e'", "'gauss'", "'c'", 'event_id')} AS c FROM events),
    binned AS (SELECT event_id, a, {edges_sql('b', 10, 'raw')} AS b, {edges_sql('c', 20, 'raw')} AS c FROM raw), {permutation_sql('b', 10, 'e')}
    SELECT event_id, a, other AS b, c FROM binned JOIN perm ON code = b""",
)
def gen_table(spark, sf):
    schema = {"a": G.Spec(12), "b": G.Spec(10, "geometric", p=0.2, shuffle=True), "c": G.Spec(20, "gauss")}
    return G.generate_table(table(spark, sf, "events").select("event_id"), ["event_id"], schema, "e")


TEN = Domain({f"x{i}": 10 for i in range(10)})


def sparse_sql(rate: float) -> str:
    """SELECT of the sparse count table of a fill rate, from ``events``."""
    n = int(TEN.cells() * rate)
    digits = ", ".join(f"CAST((range // {10 ** (9 - i)}) % 10 AS INTEGER) AS x{i}" for i in range(10))
    return f"""WITH picked AS (SELECT event_id FROM events ORDER BY {U("'e'", "'sample'", 'event_id')}, event_id LIMIT (SELECT count(*) - {n} FROM events)),
    raw AS (SELECT {geometric_sql(0.001, "'e'", "'sparse'", 'event_id')} AS x FROM picked), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM raw),
    bins AS (SELECT least(CAST(floor(round((x - lo) / ((hi - lo) / {n}::DOUBLE), 9)) AS BIGINT), {n - 1}) AS idx, count(*) AS n FROM raw CROSS JOIN lim GROUP BY 1),
    cells AS (SELECT range AS idx, {digits} FROM range({n}))
    SELECT {', '.join(f'x{i}' for i in range(10))}, coalesce(n, 0) + 1 AS v FROM cells LEFT JOIN bins USING (idx)"""


@query("gen_sparse_cells", sparse_sql(1e-8))
def gen_sparse_cells(spark, sf):
    return G.sparse_cells(table(spark, sf, "events").select("event_id"), ["event_id"], TEN, 1e-8, 0.001, "e")


LADDER = (2e-8, 1e-8, 5e-9, 1e-9)


@query(
    "gen_sparse_ladder",
    " UNION ALL ".join(f"SELECT {r!r}::DOUBLE AS rate, count(*) AS cells, CAST(sum(v) AS BIGINT) AS total, max(v) AS largest FROM ({sparse_sql(r)})" for r in LADDER),
)
def gen_sparse_ladder(spark, sf):
    """Tables of falling fill rate with the same total."""
    events, out = table(spark, sf, "events").select("event_id"), None
    for rate in LADDER:
        part = G.sparse_cells(events, ["event_id"], TEN, rate, 0.001, "e").agg(
            F.lit(rate).alias("rate"), F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"), F.max("v").alias("largest")
        )
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "gen_cells_random",
    f"""WITH {LI_SQL}, m AS (SELECT count(*) AS n FROM (SELECT DISTINCT q, d, r, t, s FROM li)),
    k AS (SELECT n, CAST(floor(-1.5::DOUBLE * 29700 * ln(greatest(1 - n / 29700::DOUBLE, 0.5::DOUBLE / 29700))) AS BIGINT) + 64 AS tries FROM m),
    draws AS (SELECT range AS id, {', '.join(f"{uniform_int('0', str(n), chr(39) + 'c' + chr(39), chr(39) + 'cell' + chr(39), chr(39) + a + chr(39), 'range')} AS {a}" for a, n in LI5.sizes.items())}
      FROM range((SELECT tries FROM k))),
    cells AS (SELECT q, d, r, t, s, row_number() OVER (ORDER BY min(id)) AS rn FROM draws GROUP BY q, d, r, t, s)
    SELECT q, d, r, t, s FROM cells CROSS JOIN m WHERE rn <= n""",
)
def gen_cells_random(spark, sf):
    """As many distinct cells of the coded lineitem domain as it really has."""
    n = lineitem_codes(spark, sf).select(*LI5.attrs).distinct().count()
    return G.random_cells(spark, LI5, n, "c")


@query(
    "gen_cells_sequential",
    f"""SELECT range AS idx, {', '.join(f'CAST((range // {10 ** (9 - i)}) % 10 AS INTEGER) AS x{i}' for i in range(10))}
    FROM range((SELECT count(*) FROM orders))""",
)
def gen_cells_sequential(spark, sf):
    return G.sequential_cells(spark, TEN, table(spark, sf, "orders").count())


@query(
    "sparsity",
    f"WITH {LI_SQL}, c AS (SELECT DISTINCT q, d, r, t, s FROM li) SELECT count(*) AS cells, count(*) / 29700::DOUBLE AS rate FROM c",
)
def sparsity(spark, sf):
    return G.sparsity(lineitem_codes(spark, sf), LI5)


# ------------------------------------------------------------------ noise draws

EK = ("'n'", "event_id")


@query("laplace_noise", f"SELECT event_id, {laplace(2.0, *EK)} AS noise FROM events")
def laplace_noise(spark, sf):
    return table(spark, sf, "events").select("event_id", noise.laplace(2.0, "n", F.col("event_id")).alias("noise"))


DL_ALPHA = math.exp(-1 / 3.0)


@query(
    "noise_columns",
    f"""SELECT event_id, {gaussian_sql("'n'", "'ga'", 'event_id')} AS gaussian,
    {settle(f"-1::DOUBLE + 3::DOUBLE * {U(chr(39) + 'n' + chr(39), chr(39) + 're' + chr(39), 'event_id')}")} AS uniform_real,
    {uniform_int('5', '25', "'n'", "'in'", 'event_id')} AS uniform_int,
    2 * {uniform_int('0', '2', "'n'", "'si'", 'event_id')} - 1 AS sign,
    {settle(f"-ln(1::DOUBLE - {U(chr(39) + 'n' + chr(39), chr(39) + 'ex' + chr(39), 'event_id')}) / 0.5::DOUBLE")} AS exponential,
    {geometric_sql(0.3, "'n'", "'ge'", 'event_id')} AS geometric,
    CASE WHEN {U("'n'", "'di'", 'event_id', "'stay'")} < {(1 - DL_ALPHA) / (1 + DL_ALPHA)!r}::DOUBLE THEN 0
      ELSE (2 * {uniform_int('0', '2', "'n'", "'di'", 'event_id', "'side'")} - 1) * ({geometric_sql(1 - DL_ALPHA, "'n'", "'di'", 'event_id', "'step'")} + 1) END AS discrete_laplace,
    {settle(settle(f"1::DOUBLE * tan({math.pi!r}::DOUBLE * ({U(chr(39) + 'n' + chr(39), chr(39) + 'ca' + chr(39), 'event_id')} - 0.5::DOUBLE))"), 3)} AS cauchy
    FROM events""",
)
def noise_columns(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        noise.gaussian(0.0, 1.0, "n", "ga", e).alias("gaussian"),
        noise.uniform_real(-1.0, 2.0, "n", "re", e).alias("uniform_real"),
        noise.uniform_int(5, 25, "n", "in", e).alias("uniform_int"),
        noise.sign("n", "si", e).alias("sign"),
        noise.exponential(0.5, "n", "ex", e).alias("exponential"),
        noise.geometric(0.3, "n", "ge", e).alias("geometric"),
        noise.discrete_laplace(3.0, "n", "di", e).alias("discrete_laplace"),
        # far tails lose digits in the tangent, so both sides compare three
        noise.settle(noise.cauchy(1.0, "n", "ca", e), 3).alias("cauchy"),
    )
