"""Whitening, spelling variants and WARC archives: against brute force and round trips, and their odd inputs."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdcflow.llm import variants, warc, whitening

SF = "/root/testdata/sf0.001"


# --- whitening


def det(m):
    """Of a matrix of fractions, by elimination."""
    m, out = [[Fraction(v) for v in row] for row in m], Fraction(1)
    for c in range(len(m)):
        pivot = next((r for r in range(c, len(m)) if m[r][c]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != c:
            m[c], m[pivot], out = m[pivot], m[c], -out
        out *= m[c][c]
        for r in range(c + 1, len(m)):
            f = m[r][c] / m[c][c]
            m[r] = [a - f * b for a, b in zip(m[r], m[c])]
    return out


def symmetric(size, most, seed):
    rng = random.Random(seed)
    b = [[rng.randint(-most, most) for _ in range(size)] for _ in range(size)]
    return [[sum(x * y for x, y in zip(p, q)) for q in b] for p in b]


@pytest.mark.parametrize("size,most", [(1, 5), (2, 10**9), (7, 3), (9, 10**12)])
def test_characteristic_polynomial_is_exact(spark, size, most):
    m = symmetric(size, most, size)
    got = whitening.characteristic_polynomial(spark, m)
    assert len(got) == size + 1
    for z in range(-size, size + 1):  # more points than its degree
        want = det([[z * (i == j) - m[i][j] for j in range(size)] for i in range(size)])
        assert sum(c * z ** (size - i) for i, c in enumerate(got)) == want


def test_roots_are_isolated_with_their_multiplicity():
    roots = [1, 1, 4, 9, 9, 9, 1000, 1001, 0, 0]
    polynomial = [1]
    for r in roots:
        polynomial = [a - r * b for a, b in zip([*polynomial, 0], [0, *polynomial])]
    found = whitening.isolated_roots(polynomial, 32)
    assert [c for *_, c in found] == [1, 1, 3, 1, 2]
    for (low, high, copies), r in zip(found, [1001, 1000, 9, 4, 1]):
        assert low < r <= high
        if copies == 1:
            assert abs(whitening.refined_root(polynomial, low, high) - r) < Fraction(1, 2**200)
    assert len(whitening.isolated_roots(polynomial, 2)) == 2
    assert whitening.isolated_roots([1, 0, 0], 5) == []


def test_null_space_of_repeated_roots_is_orthonormal():
    v = np.array(whitening.null_space([[6 * (i == j) + 3 * (i == j == 4) for j in range(5)] for i in range(5)], Fraction(6), 4))
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15 and np.abs(v[:, 4]).max() < 1e-15


def check_whitened(spark, rows, most, width):
    """rows: (vec_id, list of integers); compares with exact sums and numpy's eigenvectors."""
    df = spark.createDataFrame(rows, "vec_id long, x array<bigint>").repartition(3)
    got = whitening.whitened(df, most).collect()
    x = [list(v) + [0] * (width - len(v)) for _, v in rows if v is not None]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    want = Counter(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x)
    components = {r["component"] for r in got}
    assert components == set(range(1, len(components) + 1)) and len(got) == n * len(components)
    assert Counter(int(r["deviation_text"]) for r in got if r["component"] == 1) == want
    assert all(r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 2**63 else None) and r["n"] == n for r in got)
    v = np.array([[float(Fraction(n * sum(a[i] * a[j] for a in x) - sums[i] * sums[j], n * n)) for j in range(width)] for i in range(width)])
    e = np.linalg.eigvalsh(v)[::-1]
    explained = {r["component"]: r["explained"] for r in got}
    assert all(math.isclose(explained[c], e[c - 1] / e.sum(), rel_tol=1e-6) for c in explained)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-4
    return got


def test_whitening_matches_exact_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-200, 200, 6).tolist()) for i in range(80)]
    got = check_whitened(spark, rows, 32, 6)
    w = np.zeros((80, 6))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9
    x = np.array([v for _, v in rows], float)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    mine = (x - x.mean(axis=0)) @ u[:, ::-1] / np.sqrt(e[::-1])
    assert np.abs(np.abs(mine) - np.abs(w)).max() < 1e-8


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else i % 20, None if i % 7 == 0 else [rng.randint(-(2**40), 2**40) for _ in range(2 + i % 3)]) for i in range(60)]
    check_whitened(spark, rows, 3, 4)  # nulls, repeated ids, short vectors, sums beyond 64 bits
    flat = [(i, [i, 2 * i, 7]) for i in range(10)]
    assert {r["component"] for r in check_whitened(spark, flat, 32, 3)} == {1}  # one direction has variance
    for none in ([(1, [5, 5])] * 3, [(1, [3])], [(1, None)], []):
        out = whitening.whitened(spark.createDataFrame(none, "vec_id long, x array<bigint>"))
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
    bad = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("-inf")],)], "e array<float>")
    assert [r["q"] for r in bad.select(whitening.quantised(F.col("e")).alias("q")).collect()] == [[32, -1], None, None, None, None]


def test_whitening_of_the_table(spark):
    got = whitening.op11_embedding_whitening(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert got.count() == 32 * len(rows) and got.first()["identity_error"] < 1e-9


# --- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += len(w) >= 5
    words = sorted(w for w in n if n[w] >= 3)
    out, form = {}, {}
    for w in words:
        near = [v for v in words if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(near))
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), *out[w], n[form[w]] if form[w] else None) for w in words}


FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_match_brute_force(spark):
    rng = random.Random(11)
    base = ["colour", "théâtre", "straße", "abcdefghijklmnopqrstuvwxyzabcdef", "ÿÿÿÿÿÿ"]
    def noisy(w):
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeÉ÷z") + w[at:], w[:at] + rng.choice("oxñ") + w[at + 1 :]])
        return w
    words = [noisy(rng.choice(base)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(60)], k=120)).replace(" ", rng.choice([" ", "\n", "1", "日"]))) for i in range(40)]
    rows += [(None, "tests tests tests tests"), (1, None), (2, ""), (2, "  \n"), (5, "UPPER upper UPPER ÄÖÜÄÖÜ äöüäöü ÄÖÜÄÖÜ ÄÖÜÄÖÜ"), (5, "UPPER upper UPPER")]
    docs = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "doc_id long, text string, word string, n string, near_n int").repartition(3)
    got = {tuple(r) for r in variants.spelling_variants(docs).select(FIELDS).collect()}
    assert got == brute_variants(rows)
    assert {tuple(r) for r in variants.spelling_variants(docs, symbols=2).select(FIELDS).collect()} == got
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_variants_of_the_table_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in variants.op12_spelling_variants(spark, SF).select(FIELDS).collect()} == brute_variants([tuple(r) for r in docs.collect()])


def test_long_texts_are_cut_outside_words(spark):
    text = ("lengthy words " * 90_000 + "x" * 200_000 + " 日本 ") * 2
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = Counter(w for w in re.findall(r"[A-Za-zÀ-ÿ]+", text) if len(w) >= 5)
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, least_count=1).collect()}
    assert sum(got.values()) == sum(want.values()) and set(got) - {w[:i] + w[i + 1 :] for w in want for i in range(len(w))} <= set(want)


def test_neighbourhoods_are_whole(spark):
    k = 3
    for word in ("\1", "\1\2", "\2\2\3\1\1"):
        near = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        near |= {word[:i] + chr(c) + word[i + j :] for i in range(len(word) + 1) for c in range(1, k + 1) for j in (0, 1)}
        ((_, symbols),) = variants._by_length([word])
        made = set(variants.neighbourhood(symbols, k)[0].tolist())
        want = {0 if not w else int(variants._hash_of(w)) for w in near if w} | ({0} if "" in near else set())
        assert made == want


# --- WARC


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, payload binary, record_id string, first int")


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload or b"").digest()).decode()


def expected(rows, least):
    out = []
    for i, _, p in rows:
        p = p or b""
        ids = [j for j, _, q in rows if (q or b"") == p]
        first = min((j for j in ids if j is not None), default=None)
        revisit = len(p) >= least and i != first
        out.append((i, len(p), digest(p), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (3, "http://a/é\r\nX: y", b"same"), (1, "http://b", b"same"), (2, None, b"same"), (4, "http://c", None), (5, "http://d", b""), (None, "http://e", b"same"), (None, None, b"alone"),
    (6, "http://f", b"WARC/1.1\r\n\r\n" * 50_000), (7, "http://g", b"WARC/1.1\r\n\r\n" * 50_000), (8, "http://h", bytes(range(256)) * 3000), (9, "http://i", b"twice"), (9, "http://i", b"twice"), (10, "http://j", b"twice"),
]


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_archives_round_trip(spark, tmp_path, least):
    manifest = warc.write_archives(pages_of(spark, PAGES).repartition(3), f"file://{tmp_path}/w", least, chunk=1000)
    rows = warc.read_archives(manifest, chunk=777).collect()
    ends = [r for r in rows if r["is_last"]]
    assert sorted(((r["page_id"], r["bytes_so_far"], r["digest_so_far"], r["record_type"], r["refers_to"]) for r in ends), key=str) == expected(PAGES, least)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and max(len(r["data"]) for r in rows) <= 777
    known = {i: p or b"" for i, _, p in PAGES if i is not None}
    for page in (6, 8):
        parts = sorted((r for r in rows if r["page_id"] == page), key=lambda r: r["chunk_no"])
        assert b"".join(r["data"] for r in parts) == known[page] and [r["chunk_no"] for r in parts] == list(range(len(parts)))
        for r in parts:  # digests go with what has been read
            assert r["digest_so_far"] == digest(known[page][: r["bytes_so_far"]])
    ids = {r["record_id"]: r["page_id"] for r in ends if r["record_type"] == "response"}
    assert all(ids[r["refers_id"]] == r["refers_to"] for r in ends if r["record_type"] == "revisit")
    fast = warc.read_archives(manifest, with_data=False)
    assert fast.count() == len(PAGES) and fast.where("data is not null").isEmpty()


def test_archives_are_plain_warc(spark, tmp_path):
    """Read without the reader: gzip members, heads, lengths."""
    warc.write_archives(pages_of(spark, PAGES).coalesce(1), f"file://{tmp_path}/w").collect()
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    raw, at, seen = gzip.decompress(file.read_bytes()), 0, 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        body = raw[at + len(head) + 4 :][: int(fields["Content-Length"])]
        http, _, payload = body.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + digest(payload)
        at += len(head) + 4 + len(body)
        assert raw[at : at + 4] == b"\r\n\r\n"
        at, seen = at + 4, seen + 1
    assert seen == len(PAGES)


def test_damaged_archives_are_refused(spark, tmp_path):
    manifest = warc.write_archives(pages_of(spark, [(1, "u", b"some payload " * 100)]), f"file://{tmp_path}/w")
    path = manifest.first()["path"].removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read())
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"some payload", b"gone payload", 1)))
    with pytest.raises(Exception, match="fails its digest"):
        warc.read_archives(manifest).collect()
    with open(path, "wb") as f:
        f.write(gzip.compress(raw)[:-30])
    with pytest.raises(Exception, match="ends within a record|shorter"):
        warc.read_archives(manifest).collect()


def test_hot_payloads_and_empty_tables(spark, tmp_path):
    rows = [(i, f"u{i}", b"hot" if i % 3 else b"p%d" % (i % 400)) for i in range(3000)]
    out = warc.read_archives(warc.write_archives(pages_of(spark, rows), f"file://{tmp_path}/h"), with_data=False)
    got = sorted((tuple(r) for r in out.select("page_id", "bytes_so_far", "digest_so_far", "record_type", "refers_to").collect()), key=str)
    first = {}
    for i, _, p in rows:
        first.setdefault(p, i)
    assert got == sorted(((i, len(p), digest(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, _, p in rows), key=str)
    none = warc.write_archives(pages_of(spark, []), f"file://{tmp_path}/e")
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_training_rows_are_bounded_where_ids_repeat(spark):
    from cdcflow.llm import text_stats

    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(2, None), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in text_stats.labelled_sample(docs, labels, "quality", 10).collect()) == [(1, "text 0", 0), (2, None, 1)]
