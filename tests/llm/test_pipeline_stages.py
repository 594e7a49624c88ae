"""Each stage of the pipeline against a brute-force version of it, on a small fixture; texts are ASCII, so that DuckDB's distances count characters."""

import hashlib
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
import tiktoken.load

import corpus_pipeline
import public_tokenizers as P
from cdcflow.llm import quality_rules, text_stats
from test_llm import SF, WORDS, labels, sample_docs, shingle_set, stats_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TARGET_WEIGHTS = (5, 2, 1)


def fixture_rows():
    """Texts of lines of 30 words; some lines come again in other texts, as they are or with a changed word; some texts are copies but for a word."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9)))
    line = lambda: " ".join(word() for _ in range(30))
    shared, texts = [line() for _ in range(4)], [None, "", " \n\t"]
    for i in range(24):
        lines = [line() for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            again = shared[i % 4].split(" ")
            again[rng.randrange(30)] += rng.choice(("", "s", "ed"))
            lines.insert(rng.randint(0, len(lines)), " ".join(again).title() if i % 2 else "  ".join(again))
        texts.append("\n".join(lines))
    texts += [shared[1], shared[2] + "\n\n"]  # these lose every line
    for i in range(6):  # copies of a text but for a word, and one that differs by half
        w = texts[5 + i].split(" ")
        texts.append(" ".join(w[:-1] + [word()]))
        texts.append(" ".join(w[: len(w) // 2] + [word() for _ in w[len(w) // 2 :]]))
    sources = ("small", "b", "hot", "hot", None, "hot")
    return [(i, t, "en" if i % 4 else None, sources[i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA)


def joined(groups, a, b):
    """groups with those of a and b as one, named by the smaller."""
    low, high = sorted((groups[a], groups[b]))
    return {k: low if g == high else g for k, g in groups.items()}


def ratios_of(text):
    text = text or ""
    n_words, word_chars, symbols, dup_lines, repeats = stats_of(text)
    of = lambda pattern, among: len(re.findall(pattern, text)) / max(among, 1)
    return {
        "mean_word": word_chars / max(n_words, 1), "symbols": symbols / max(n_words, 1), "dup_lines": dup_lines / (text.count("\n") + 1), "repeats": repeats / max(n_words, 1),
        "distinct": len(set(WORDS.findall(text))) / max(n_words, 1), "upper": sum(c.isupper() for c in text) / max(word_chars, 1), "marks": of("[!?]", n_words), "digits": of("[0-9]", n_words), "stops": of("[.,;:]", n_words),
    }


def test_quality_rules_stage(spark):
    docs = sample_docs(spark)
    rows = [r.asDict() for r in text_stats.labelled_sample(docs, labels(spark), "quality", 8000).collect()]
    fails = lambda t: stats_of(t)[0] < 20 or 100 * stats_of(t)[4] > 30 * stats_of(t)[0]
    rules = quality_rules.learn_rules([ratios_of(r["text"]) | {"k_label": r["k_label"]} for r in rows if not fails(r["text"])])
    meets = lambda rule, x: all(x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold for c in rule)
    want = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect() if not fails(r["text"]) and not any(meets(rule, ratios_of(r["text"])) for rule in rules)]
    got = [tuple(r) for r in corpus_pipeline.rules_stage(spark, docs, SF).collect()]
    assert rules and 0 < len(want) < docs.count() and sorted(got, key=repr) == sorted(want, key=repr)


def test_line_dedup_stage(spark, docs):
    rows = fixture_rows()
    norm = {(r[0], n): " ".join(WORDS.findall(x.lower())) for r in rows if r[1] for n, x in enumerate(r[1].split("\n")) if WORDS.search(x)}
    frame = pd.DataFrame({"k": sorted(set(norm.values()))})  # noqa: F841
    groups = {k: k for k in norm.values()}
    for a, b in duckdb.sql("SELECT x.k, y.k FROM frame x JOIN frame y ON x.k < y.k WHERE levenshtein(x.k, y.k) <= floor(0.2 * greatest(length(x.k), length(y.k)) + 1e-9)").fetchall():
        groups = joined(groups, a, b)
    first = {}
    for place in sorted(norm):
        first.setdefault(groups[norm[place]], place)
    want = []
    for i, text, lang, source, n_chars in rows:
        places = [n for n in range(len((text or "").split("\n"))) if (i, n) in norm]
        drop = {n for n in places if first[groups[norm[i, n]]] != (i, n)}
        if not drop:
            want.append((i, text, lang, source, n_chars))
        elif len(drop) < len(places):
            left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
            want.append((i, left, lang, source, len(left)))
    got = sorted(map(tuple, corpus_pipeline.lines_stage(spark, docs, SF).collect()))
    assert got == want and len(want) < len(rows) and sum(a[1] != b[1] for a, b in zip(want, (rows[w[0]] for w in want))) > 5


def test_near_dedup_stage(spark, docs):
    rows = fixture_rows()
    sets, groups = [shingle_set(r[1]) for r in rows], {r[0]: r[0] for r in rows}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups = joined(groups, i, j)
    want = [r for r in rows if groups[r[0]] == r[0]]
    assert sorted(map(tuple, corpus_pipeline.near_stage(spark, docs, SF).collect())) == want and 0 < len(rows) - len(want) < 12


def test_mixing_stage(spark, docs):
    rows = fixture_rows()
    size = {r[0]: len(WORDS.findall(r[1] or "")) for r in rows}
    of = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    names = sorted((s for s in of if s is not None)) + [s for s in of if s is None]
    weight = {s: TARGET_WEIGHTS[i % 3] for i, s in enumerate(names)}
    # targets: raise all by weight alike until the words are used up, none above three times its source
    low, high = 0.0, float(sum(of.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * of[s], level * weight[s]) for s in names) < sum(of.values()) else (low, level)
    copies = Counter(map(tuple, corpus_pipeline.mix_stage(spark, docs, SF).collect()))
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    for s in names:
        taken = sum(n * size[r[0]] for r, n in copies.items() if r[3] == s)
        assert abs(taken - min(3 * of[s], low * weight[s])) <= max(size[r[0]] for r in rows if r[3] == s) + 1e-6
    assert copies == Counter(map(tuple, corpus_pipeline.mix_stage(spark, docs.repartition(3), SF).collect()))


def test_bpe_stage(spark, docs):
    ranks = tiktoken.load.load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("fixture", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.bpe_stage(spark, docs, SF).collect()}
    assert len(got) == len(fixture_rows())
    for i, text, lang, source, _ in fixture_rows():
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        r = got[i]
        assert (bytes(r["ids"]), r["n_tokens"], r["lang"], r["source"]) == (packed, len(ids), lang, source) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["ids_sha256"], r["decoded_sha256"]) == (hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
