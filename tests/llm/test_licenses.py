"""License scans: standard layouts among other text, and all windows by plain code."""

import re

import numpy as np
import pytest
from pyspark.sql import Row

from cellview.llm import licenses

OTHER = "amber brook cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean plain quarry ridge shore trail".split()
LONG = {n: t for n, t in licenses.TEMPLATES if len(t) > 300}


def other(seed, n):
    return " ".join(np.random.default_rng(seed).choice(OTHER, n))


def layout(text, how):
    sentences = re.split(r"(?<=[.:]) (?=[A-Z\"])", text)
    lines = [" ".join(text.split(" ")[k : k + 11]) for k in range(0, text.count(" ") + 1, 11)]
    return {"paragraphs": "\n\n".join(sentences), "lines": "\n".join(lines), "one line": text, "comment": "\n".join(f" * {x}" for x in lines)}[how]


@pytest.mark.parametrize("how", ["paragraphs", "lines", "one line", "comment"])
def test_standard_layouts_inside_other_text(spark, how):
    gap = " " if how == "one line" else "\n\n"
    rows = [(k, gap.join([other(k, 200), layout(t, how), other(k + 50, 400)])) for k, t in enumerate(LONG.values())]
    docs = spark.createDataFrame([*rows, (99, other(1, 900))], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs, licenses.templates(spark)).where("dice >= 0.95").collect()}
    assert found == {(k, n) for k, n in enumerate(LONG)}


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(w):
    return set(zip(w, w[1:], strict=False))


def test_edited_copies_against_all_windows(spark):
    """Wherever some window as long as a template matches, with words changed at random, the scan finds it."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        text = list(LONG.values())[k % len(LONG)].split(" ")
        for at in rng.choice(len(text), int(len(text) * (k % 12) / 100), replace=False):
            text[at] = str(rng.choice(OTHER))
        rows.append((k, f"{other(k, 30)} {' '.join(text)} {other(k + 99, 30)}"))
    want = set()
    for i, text in rows:
        w = words(text)
        for name, t in LONG.items():
            b, n = bigrams(words(t)), len(words(t))
            windows = (bigrams(w[s : s + n]) for s in range(max(1, len(w) - n + 1)))
            if any(200 * len(x & b) >= 80 * (len(x) + len(b)) for x in windows):
                want.add((i, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs, licenses.templates(spark)).collect()}
    assert 20 < len(want) < 60 and want <= found


def test_every_match_has_an_anchor():
    plan = licenses.DiceScan()
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        w = words(text)
        b = [" ".join(x) for x in bigrams(w)]
        marks = licenses.anchors([Row(template=k, words=w, bigrams=b, size=len(b))], plan)
        shared = -(-len(b) * plan.percent // (200 - plan.percent))  # fewest bigrams of a match
        assert len(b) - len(marks) < shared
