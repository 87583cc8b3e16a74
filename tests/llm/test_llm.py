"""Training-data operators against SQL, brute force and planted cases."""

import base64
import gzip
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellview.catalog.base import Entry
from cellview.llm import class_lm, decontaminate, html_text, language, licenses, minhash_dedup, mixing, projection_dedup, secrets, toxicity
from cellview.llm.common import components
from cellview.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, long, "en", "a", len(long)), (5, long, "en", "a", len(long)),
        (None, prose(2, 40), "fr", None, 9), (6, "one", "en", "b", 3), (6, "one", "en", "b", 3), (7, "one two", None, "b", 7), (8, "12 34 !!", "de", "b", 8),
        (9, prose(3, 60), "de", "c", 1), (10, prose(3, 60) + " extra", "de", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("component", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("slot", F.lit(2))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(name, spark, con, sf):
    assert compare(Entry(QUERIES[name], ORACLE_SQL[name]), spark, con, sf) == ""


def shingles(text, n=3):
    low = (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + k) for k in range(200)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert {n: c for n, c in want.items() if n in got} == got
    assert all(want[n] == n for n in want if n not in got)


def brute_links(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]


def test_minhash_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = roots(texts, brute_links(texts))
    for r in minhash_dedup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_of_many_near_copies(spark):
    base = prose(9, 150).split()
    rng, texts = np.random.default_rng(4), {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 7)):
            w[rng.integers(0, 150)] = f"w{rng.integers(0, 60)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = roots(texts, brute_links(texts))
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == want


def test_projection_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    extra = [(10_000 + k, (base + 0.02 * rng.standard_normal(64)).tolist(), 77) for k in range(90)] + [(20_000 + k, base.tolist(), 77) for k in range(5)]
    bad = [(30_000, None, 77), (30_001, [0.0] * 64, 77), (30_002, [float("nan")] * 64, 77), (30_003, [None] * 64, 77), (30_004, base.tolist(), None), (None, base.tolist(), 77)]
    made = spark.createDataFrame(extra + bad, "vec_id long, embedding array<double>, label int")
    both = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").unionByName(made)
    got = {r.vec_id: r for r in projection_dedup.near_duplicates(both, projection_dedup.Passes(tile=32)).collect()}
    table = both.where("label IS NOT NULL AND vec_id < 30000").toPandas().sort_values("vec_id")
    links, n = [], Counter()
    for _, g in table.groupby("label"):
        x = np.stack(g.embedding.to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        ids = g.vec_id.to_numpy()
        links += [(int(ids[i]), int(ids[j])) for i, j in zip(a, b, strict=True)]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = roots([int(i) for i in table.vec_id], links)
    found = sum(min(got[i].n_links, n[i]) for i in want)
    assert found >= 0.9 * sum(n.values()) and all(got[i].n_links <= n[i] for i in want)
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)
    for i in (30_000, 30_001, 30_002, 30_003, 30_004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept


def test_decontamination_tolerates_substitutions(spark):
    item = prose(21, 40).split()
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, prose(22, 300)), (2, prose(23, 50) + " " + " ".join(changed) + "."), (3, " ".join(item[5:30]).upper()), (4, None), (None, " ".join(item))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()} == {(2, 7), (3, 7), (None, 7)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [1, 4]


def test_seeds_hit_every_allowed_window():
    plan = decontaminate.SpacedSeeds()
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in plan.masks]
    for n in range(plan.span, plan.window + 1):
        for odd_start in range(plan.stride):
            at = [p for p in range(n - plan.span + 1) if (p + odd_start) % plan.stride == 0]
            for changed in itertools.combinations(range(n), n * (100 - plan.percent) // 100):
                assert any(all(p + i not in changed for i in m) for p in at for m in kept), (n, odd_start, changed)


def test_decontamination_equals_all_windows(spark):
    """Against SQL that compares every window of every document with every item, without seeds."""
    import duckdb

    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in (8, 9, 10, 11, 12, 13, 20)]
    docs = []
    for n, words in items:
        for more in (0, 1):
            for changed in itertools.combinations(range(min(n, 13)), n * 20 // 100 + more if n < 13 else 2 + more):
                new = ["other" if k in changed else w for k, w in enumerate(words)]
                for start in (2, 3):
                    docs.append((len(docs), " ".join([*WORDS[:start], *new, *WORDS[5:8]])))
    docs = [d for d in docs if d[0] % 5 == 0 or d[0] % 7 == 3]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE i (item_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO d SELECT unnest(?), unnest(?)", [[d[0] for d in docs], [d[1] for d in docs]])
    con.execute("INSERT INTO i SELECT unnest(?), unnest(?)", [[n for n, _ in items], [" ".join(w) for _, w in items]])
    wanted = con.execute("""WITH dw AS (SELECT doc_id, string_split(text, ' ') AS dw FROM d), iw AS (SELECT item_id, string_split(text, ' ') AS iw FROM i),
s AS (SELECT doc_id, item_id, least(13, len(iw)) AS wide, len(iw) AS n, dw, iw, unnest(range(1 - len(iw), len(dw))) AS shift FROM dw, iw),
p AS (SELECT doc_id, item_id, wide, dw, iw, shift, unnest(range(0, n - wide + 1)) AS a FROM s),
e AS (SELECT doc_id, item_id, wide, len(list_filter(range(a, a + wide), lambda j: iw[j + 1] = dw[j + shift + 1])) AS equal FROM p WHERE a + shift >= 0 AND a + shift + wide <= len(dw))
SELECT doc_id, item_id, max(equal) FROM e WHERE equal * 100 >= wide * 80 GROUP BY ALL""").fetchall()
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.window_equal) for r in found.collect()} == set(wanted) and 0 < len(wanted) < len(docs)


def test_secrets_in_layers():
    key = "AKIA" + "ABCDEFGH12345678"
    inner = f"password = hunter2secret {key}"
    gz = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(base64.b64encode(inner.encode())).decode()
    escaped = "".join(f"%{b:02X}" for b in key.encode())
    uni = "".join(f"\\u{ord(c):04x}" for c in key)
    for blob in (gz, twice, escaped, uni, "".join(f"&#{ord(c)};" for c in key)):
        text = f"é before {blob} after"
        spans, oversize = secrets.all_spans(text)
        assert not oversize and secrets.base_spans(text) == [s for s in spans if s in secrets.base_spans(text)]
        assert (9, 9 + len(blob), "access") in spans, blob[:20]
    assert secrets.base_spans('token: "abc12" secret=abcdef ' + "0" * 24) == [(15, 28, "assign"), (29, 53, "hex")]
    bomb = base64.b64encode(gzip.compress(b"a" * 100_000)).decode()
    assert secrets.all_spans(bomb, secrets.Unwrapping(most_bytes=1000))[1] == 1
    assert secrets.all_spans("")[0] == [] and secrets.redacted(f"x {key} y", secrets.base_spans(f"x {key} y")) == "x [SECRET] y"


def test_secrets_of_equal_blobs():
    key = "AKIA" + "ABCDEFGH12345678"
    plain = base64.b64encode(f"the key is {key}".encode()).decode()
    nested = base64.b64encode(gzip.compress(f"first {plain} then {plain}".encode())).decode()
    for blob in (plain, nested):
        text = f"a {blob} b {blob}\nc {blob}"
        spans, _ = secrets.all_spans(text)
        assert [(s, e) for s, e, kind in spans if kind == "access"] == [(m.start(), m.end()) for m in re.finditer(re.escape(blob), text)]
        assert secrets.redacted(text, spans) == "a [SECRET] b [SECRET]\nc [SECRET]"


def test_html_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_text.learn(pages)
    import html

    for r, got in zip(pages.orderBy("page_id").collect(), html_text.extract(pages, model=model).orderBy("page_id").collect(), strict=True):
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got.text == " ".join(html.unescape(re.sub(r"</?[a-z0-9]+>", " ", inside)).split()) and got.n_chars == len(got.text)
    page = '<body><nav>Home</nav><div class="cookie-notice"><p>We use cookies, ok.</p></div><div class="post-content"><h1>Title</h1><p>Some <b>bold</b> text, it goes on. And on.</p></div><div class="comments"><p>I like it, thanks.</p></div><footer>c</footer>'
    assert html_text.main_text(page, model) == "Title Some bold text, it goes on. And on."
    assert "<" not in html_text.main_text("<article>" + '<p>Some <a href="foo>text</a> here.</p>' * 3 + "</article>", model)
    assert html_text.main_text(None, model) == html_text.main_text("<", model) == html_text.main_text("<p", model) == ""


def test_marginals_equal_enumeration():
    """Sum-product on a small tree against all labellings."""
    from itertools import product
    from math import exp

    model = {"seen": {}, "step": {"": ((-0.2, -1.7), (-2.0, -0.15)), "p": ((-0.9, -0.5), (-1.2, -0.4))}, "temper": 1.0}
    nodes, _ = html_text.parse("<div><p>a</p><section><p>b</p></section></div>")
    for i in range(len(nodes)):
        for f in html_text.features(nodes, i):
            model["seen"][f] = (-0.1 * len(f) % 1, -0.17 * len(f) % 1)
    weight, each = 0.0, np.zeros(len(nodes))
    for labels in product((0, 1), repeat=len(nodes)):
        score = 0.0
        for i, n in enumerate(nodes):
            score += sum(model["seen"][f][labels[i]] for f in html_text.features(nodes, i))
            if i:
                score += model["step"].get(n.tag, model["step"][""])[labels[n.parent]][labels[i]]
        weight += exp(score)
        each += exp(score) * np.array(labels)
    assert html_text.marginals(nodes, model) == pytest.approx(list(each / weight))


def test_toxicity_and_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lang = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    judged = toxicity.judge(docs, labels).join(labels, "doc_id").where(held)
    rates = {r.toxic: r.p for r in judged.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.75 and rates[0] < 0.01


def test_class_model_counts_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = class_lm.score(docs, *class_lm.fit(docs)).collect()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))) + [None] for r in docs.collect()}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_mix_stays_within_a_block(spark):
    docs = spark.createDataFrame([(k, "t", "a" if k % 10 else ("b" if k % 20 else "c")) for k in range(4000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, units int")
    plan = mixing.Mix(block_rows=4)
    rows = mixing.schedule(docs, targets, plan).collect()
    assert len({(r.slot, r.block_offset) for r in rows}) == len(rows) == 4000
    order = [s for _, s in sorted({(r.slot, r.source) for r in rows})]
    assert len(order) == len({r.slot for r in rows})
    done, first_dry = Counter(), min(200 // 4 * 10 // 3, 200 // 4 * 10 // 2)
    for t, s in enumerate(order[: first_dry // 10 * 10], 1):
        done[s] += 1
        assert all(abs(done[x] - t * u / 10) < 1 for x, u in (("a", 5), ("b", 3), ("c", 2)))


def test_odd_rows(spark, odd):
    empty = odd.where("1 = 0")
    for docs, n in ((odd, odd.count()), (empty, 0)):
        assert minhash_dedup.near_duplicates(docs).count() == n
        assert mixing.schedule(docs).count() == n
        assert secrets.scan(docs).count() == n
        assert language.identify(docs).count() == n
        assert class_lm.score(docs, *class_lm.fit(docs)).count() == n
        labels = spark.createDataFrame([(4, 1), (9, 0), (None, 1), (10, None)], "doc_id long, toxic int")
        assert toxicity.judge(docs, labels).count() == n
        assert licenses.scan(docs, licenses.templates(spark)).count() == 0
        assert decontaminate.clean_documents(docs, spark.createDataFrame([], "item_id long, text string")).count() == n
    same = {r.doc_id: r for r in minhash_dedup.near_duplicates(odd).where("doc_id IS NOT NULL").collect()}
    assert same[5].component_id == 4 and not same[5].kept and same[1].n_shingles == 0 and same[10].component_id == 9
    assert {r.doc_id: r.lang_pred for r in language.identify(odd).where("doc_id IN (1, 2, 3, 8)").collect()} == {1: "und", 2: "und", 3: "und", 8: "und"}
    assert projection_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert html_text.extract(spark.createDataFrame([(1, None, None), (2, "u", "")], "page_id long, url string, html string")).where("text = '' AND n_chars = 0").count() == 2


def test_pipeline_equals_its_operators(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    langs = {r.doc_id for r in language.identify(docs).where("lang_pred <> 'und'").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in langs}
    root = roots(texts, brute_links(texts))
    kept = {i for i in texts if root[i] == i}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    flat = {i: " " + " ".join(re.findall(r"\w+", texts[i].lower())) + " " for i in kept}
    clean = {i for i in kept if not any(f" {' '.join(w)} " in flat[i] for w in items)}
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    assert all(not secrets.base_spans(r.text) for r in rows)
