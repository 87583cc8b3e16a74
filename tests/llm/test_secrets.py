"""Layers of every kind, a second implementation of the base spans, and clashing columns."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from cellview.llm import secrets

KEY = "AKIA" + "ABCDEFGH12345678"
INNER = f"the key is {KEY}, keep it"
b64 = lambda data: base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def deep(data: bytes, n: int) -> bytes:
    for _ in range(n):
        data = gzip.compress(data)
    return data


CASES = {
    "byte order mark": b64("\ufeff" + INNER),
    "no-break space": b64(INNER + "\u00a0x"),
    "NUL": b64(INNER + "\0\1\x1b[0m"),
    "UTF-16": b64(INNER.encode("utf-16")),
    "UTF-16 big-endian, no mark": b64(INNER.encode("utf-16-be")),
    "Latin-1": b64((INNER + " \u00e9t\u00e9").encode("latin-1")),
    "nine gzip layers": b64(deep(INNER.encode(), 9)),
    "two gzip members": b64(gzip.compress(b"nothing here") + gzip.compress(INNER.encode())),
    "damaged gzip end": b64(gzip.compress(INNER.encode() * 50)[:-9]),
    "bzip2": b64(bz2.compress(INNER.encode())), "xz": b64(lzma.compress(INNER.encode())), "zlib": b64(zlib.compress(INNER.encode())),
    "gzip behind a header": b64(b"HEADER01" + gzip.compress(INNER.encode())),
    "wrapped plain": base64.encodebytes((INNER + " padding" * 30).encode()).decode().rstrip(),
    "wrapped gzip": base64.encodebytes(gzip.compress((INNER + "".join(map(chr, range(33, 126))) * 3).encode())).decode().rstrip(),
    "base64 in escapes": "".join(f"%{b:02X}" for b in b64(INNER).encode()),
    "escapes in base64": b64("".join(f"\\u{ord(c):04x}" for c in INNER)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_every_layer_is_read(name):
    blob = CASES[name]
    text = f"\u00e9 before {blob} after, and more"
    spans, oversize = secrets.all_spans(text)
    assert not oversize
    found = [(s, e) for s, e, kind in spans if kind == "access"]
    assert found and min(s for s, _ in found) >= 9 and max(e for _, e in found) <= 9 + len(blob)
    clean = secrets.redacted(text, spans)
    assert clean.startswith("\u00e9 before [SECRET]") and clean.endswith(" after, and more") and not [k for _, _, k in secrets.all_spans(clean)[0]]


@pytest.mark.parametrize("glue", ["a", "xy", "abc", "word"])
def test_runs_glued_to_letters(glue):
    for blob in (b64(INNER), b64(gzip.compress(INNER.encode()))):
        assert any(kind == "access" for _, _, kind in secrets.all_spans(f"see {glue}{blob} end")[0])


def test_assignments_across_escapes():
    text = "say password%3D%22hunter2secret%22 now"
    assert secrets.redacted(text, secrets.all_spans(text)[0]) == "say [SECRET]%22 now"
    assert secrets.all_spans("a&b 100% done \\ x &nosuch; plain words only")[0] == []


def test_nested_escapes_in_front_of_long_prose_are_fast():
    text = "%" + "25" * 1500 + "41KIAABCDEFGH12345678 " + "some plain words go on here " * 4000
    start = time.time()
    spans = secrets.all_spans(text)[0]
    assert time.time() - start < 5 and (0, text.index(" "), "access") in spans  # the digits are a hex run besides


def test_unread_runs_are_covered():
    bomb = b64(gzip.compress(b"a" * 300_000))
    plan = secrets.Unwrapping(most_bytes=100_000)
    spans, opaque = secrets.unwrapped(f"x {bomb} y", plan)
    assert spans == [] and opaque == [(2, 2 + len(bomb))] and secrets.redacted(f"x {bomb} y", spans, opaque) == "x [SECRET] y"
    many = " ".join(b64(gzip.compress(bytes([65 + i]) * 50_000)) for i in range(9))
    assert secrets.all_spans(many, secrets.Unwrapping(most_total=200_000))[1] == 5


def second(text):
    """Base spans again, by hand-written scanning."""
    out, low = [], text
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in low)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for name in names:
            if fold.startswith(name, i):
                j = i + len(name)
                for quote in ((1, 0) if text[j : j + 1] in ("'", '"') and text[j : j + 1] else (0,)):
                    k = j + quote
                    while text[k : k + 1] == " ":
                        k += 1
                    if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                        continue
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
                    m = k
                    while m < len(text) and text[m] in value:
                        m += 1
                    if m > k:
                        end = m
                        if m - k >= 6:
                            out.append((i, m, "assign"))
                        break
                if end:
                    break
        i = end or i + 1
    for kind, begins, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            m = i + len(begins)
            if text.startswith(begins, i):
                while m < len(text) and text[m] in chars:
                    m += 1
            if m > i + len(begins):
                if m - i >= least:
                    out.append((i, m, kind))
                i = m
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_query_equals_a_second_implementation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, some = {r.doc_id: r.text or "" for r in docs.collect()}, 0
    for r in secrets.scan(docs).collect():
        want = second(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k in want) for kind in secrets.KINDS)
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        some += bool(want)
    assert some


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, f"see {b64(INNER)}", 9), (2, None, 0), (None, "clean", 5)], "doc_id long, text string, n_chars int")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("spans", "redacted", "text_", "n_hex", "row", "found")])
    got = secrets.without_secrets(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((r.text or "", r.n_chars, r.spans, r.row) for r in got.collect()) == [("", 0, 1, 1), ("clean", 5, 1, 1), ("see [SECRET]", 12, 1, 1)]
    with pytest.raises(ValueError):
        secrets.scan(docs, ["doc_id", "spans"])
