"""Each operator against brute force, exact round trips or held-out accuracy, and its odd inputs."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from cdcflow.llm import byte_bpe, graph, language, line_dedup, masked_lm, mixing, near_dedup, pairwise, quality_rules, seekable, text_stats, token_files, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = [None, "", "  \n\t", "one", "two words", "tie tie tie tie tie tie tie tie tie tie tie tie", "日本語 text é", "x" * 40_000, "long line " * 9000]


def odd_docs(spark):
    rows = [(None if i == 3 else i % 9, t, None if i % 2 else "en", None if i % 3 else "b", None, "e") for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, COLUMNS)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def sample_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_topk_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)] if i % 7 else [0, 0, 1, 0]) for i in range(300)] + [(7, None), (None, [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "vec_id long, q array<bigint>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, 64, 4).orderBy("query_id", "rank").collect()
    known = [(i, q) for i, q in rows if i is not None and q]
    for query, mine in ((i, q) for i, q in known if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(mine, q)), i) for i, q in known if i != query)[:5]
        assert [(r["score"], r["vec_id"]) for r in got if r["query_id"] == query] == [(-s, i) for s, i in best]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_goes_by_row_where_ids_repeat(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (0, [3, 0]), (1, [5, 5]), (1, [5, 5]), (2, [0, 1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, q array<bigint>"), F.col("vec_id") % 50 == 0, 3, 2, 1).collect()
    want = []
    for i, (query, mine) in enumerate(rows):
        if query == 0:
            best = sorted((-sum(a * b for a, b in zip(mine, q)), v) for j, (v, q) in enumerate(rows) if j != i)[:3]
            want += [(query, n, v, -s) for n, (s, v) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_quantised_leaves_out_bad_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])], "vec_id long, e array<float>")
    assert [r["q"] for r in df.select(topk.quantised(F.col("e")).alias("q")).collect()] == [[128, -1], None, None, None, None]


def stats_of(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = {}, set()
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_stats_match_brute_force(spark):
    docs = sample_docs(spark).select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text"))
    for r in text_stats.with_base_stats(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats_of(r["text"])


def test_rules_learn_and_judge(spark):
    rows = [{"a": i / 100, "b": (i * 7 % 100) / 100, "k_label": 0 if i / 100 > 0.7 and (i * 7 % 100) / 100 > 0.5 else 1} for i in range(100)] * 3
    rules = quality_rules.learn_rules(rows, ["a", "b"])
    assert rules and all((r["k_label"] == 0) == any(all(c.holds(r) for c in rule) for rule in rules) for r in rows)
    assert quality_rules.learn_rules([], ["a"]) == []
    out = quality_rules.quality_rules(sample_docs(spark), labels(spark))
    judged = out.join(labels(spark), "doc_id").where(~F.col("base_failed"))
    assert judged.where("quality = 1 and not kept").count() <= 0.02 * judged.count()
    odd = quality_rules.quality_rules(odd_docs(spark), labels(spark)).collect()
    assert len(odd) == len(ODD) * 2 and all(r["base_failed"] and not r["kept"] for r in odd if stats_of(r["text"])[0] < 20)
    assert quality_rules.quality_rules(empty_docs(spark), labels(spark)).count() == 0


def test_rules_verdict_matches_brute_force(spark):
    docs = sample_docs(spark)
    sample = text_stats.with_ratios(text_stats.with_base_stats(text_stats.labelled_sample(docs, labels(spark), "quality", 8000)))
    rows = sample.select("k_label", quality_rules.base_failed().alias("out"), *text_stats.RATIOS).collect()
    rules = quality_rules.learn_rules([r for r in rows if not r["out"]])
    for r in quality_rules.quality_rules(docs, labels(spark)).collect():
        n_words, *_, n_repeat = stats_of(r["text"])
        failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        taken = next((i for i, rule in enumerate(rules, 1) if all(r[c.feature] >= c.threshold if c.above else r[c.feature] <= c.threshold for c in rule)), None)
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, taken, not failed and taken is None)


def test_clashing_columns_are_carried(spark):
    names = ["n_words", "w", "_p2", "kept", "lang"]
    docs = sample_docs(spark).select("doc_id", "text", "source").limit(9)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = quality_rules.quality_rules(docs, labels(spark), carry=names).collect()
    assert all([r["w"], r["_p2"], r["lang"]] == ["w", "_p2", "lang"] and isinstance(r["n_words"], int) and isinstance(r["kept"], bool) for r in out) and len(out) == 9
    names = ["size", "h", "h0", "c0", "budget", "text", "carried"]
    for n in names:
        docs = docs if n == "text" else docs.withColumn(n, F.lit(n))
    out = mixing.mixed(docs, carry=names).collect()
    assert len(out) == 9 and all([r[n] for n in ("h", "h0", "c0", "budget", "carried")] == ["h", "h0", "c0", "budget", "carried"] and isinstance(r["size"], int) and len(WORDS.findall(r["text"])) == r["size"] for r in out)


def test_classifier_ranks_held_out_documents(spark):
    df = pairwise.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    rows = df.collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    odd = pairwise.quality_scores(odd_docs(spark), labels(spark)).collect()
    assert len(odd) == len(ODD) * 2 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in pairwise.quality_scores(odd_docs(spark), labels(spark).limit(0)).collect()} == {pairwise.CUT}


def test_classifier_scores_match_brute_force(spark):
    docs = sample_docs(spark)
    sample = text_stats.labelled_sample(docs, labels(spark), "quality", 8000, ~pairwise.held_out(5, 0))
    ranker = pairwise.learn_ranker(text_stats.with_ratios(text_stats.with_base_stats(sample)).select("k_label", *text_stats.RATIOS).collect())
    for r in pairwise.quality_scores(docs, labels(spark)).collect():
        raw = float(ranker.features(np.array([[r[n] for n in text_stats.RATIOS]]))[0] @ ranker.weights)
        z = min(500, max(-500, (raw - ranker.threshold) * ranker.slope)) + np.log(0.3 / 0.7)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert pairwise.quality_scores(empty_docs(spark), labels(spark)).count() == 0
    twice = pairwise.quality_scores(docs.union(docs), labels(spark)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("s")).collect()
    assert all((r["n"], r["s"]) == (2, 1) for r in twice)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    vocabulary = P.path("word_bpe_49k.json")
    docs = odd_docs(spark).select("doc_id", "text", "extra")
    manifest = token_files.write_token_files(docs, vocabulary)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    t = Tokenizer.from_file(vocabulary)
    start, seen = 0, []
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        seen.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    want = []
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(seen, key=order) == sorted(want, key=order) and [s[0] for s in seen] == [w[0] for w in sorted(want, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert token_files.read_token_files(token_files.write_token_files(empty_docs(spark), vocabulary)).count() == 0


def test_seekable_file_reads_one_document_and_sees_damage(tmp_path):
    uri = f"file://{tmp_path}/x.zst"
    w = seekable.Writer(uri, 2)
    for i in range(5):
        w.add(None if i == 2 else i, np.arange(i * 100, i * 100 + 50))
    w.close()
    r = seekable.Reader(uri)
    assert r.tokens(3).tolist() == list(range(300, 350)) and r.find(4) == [4] and r.find(2) == []
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[int(r.starts[1]) + 12] ^= 255
    (tmp_path / "x.zst").write_bytes(raw)
    damaged = seekable.Reader(uri)
    assert damaged.tokens(0).tolist() == list(range(50))
    with pytest.raises(Exception):
        damaged.tokens(1)


def test_piece_encoder_equals_the_tokenizer():
    e, r = token_files.PieceEncoder(P.path("word_bpe_49k.json")), random.Random(5)
    signs = "abcxyzABZ0129'.,!?-_*#<>|/ \t\n\x0b\x1c\x85 éÉñßİΣς̧日本😀½"
    texts = ["".join(r.choice(signs) for _ in range(40)) for _ in range(500)] + ["don't <|endoftext|> we'll"]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    j = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    j["normalizer"]["normalizers"].pop()  # no lower case any more
    path = tmp_path / "other.json"
    path.write_text(json.dumps(j), encoding="utf-8")
    e, t = token_files.PieceEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["Some Words that AREN'T lower", "", "x  Y"]
    assert token_files.splits_at_space(P.path("word_bpe_49k.json")) and not e.by_piece
    assert [i.tolist() for i in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_stitches_exactly(spark):
    vocabulary = P.path("byte_bpe_multi_50k.tiktoken")
    e = byte_bpe.encoding(vocabulary, P.PATTERN)
    docs = odd_docs(spark).unionByName(sample_docs(spark).withColumn("extra", F.lit("e")).limit(60))
    for sizes in ((60, 12, 200, 40), (byte_bpe.CHUNK, byte_bpe.OVERLAP, byte_bpe.SPREAD, byte_bpe.SPREAD_OVERLAP), (2000, 200, 20_000, 400)):
        coded = byte_bpe.bpe_encode(docs, vocabulary, P.PATTERN, ["text"], *sizes)
        rows = byte_bpe.bpe_decode(coded, vocabulary).collect()
        assert len(rows) == docs.count()
        for r in rows:
            text = r["text"] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == e.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert byte_bpe.coded_digests(empty_docs(spark), vocabulary, P.PATTERN).count() == 0
    clash = empty_docs(spark).select("doc_id", "text", F.lit(1).alias("uid"), F.lit(1).alias("text_"), F.lit(1).alias("piece"))
    clash = clash.union(spark.createDataFrame([(1, "some text " * 9, 2, 3, 4)], clash.schema))
    row = byte_bpe.bpe_encode(clash, vocabulary, P.PATTERN, ["uid", "text_", "piece"], 20, 8, 40, 16).collect()[0]
    assert (row["uid"], row["text_"], row["piece"]) == (2, 3, 4) and np.frombuffer(row["ids"], "<u4").tolist() == e.encode_ordinary("some text " * 9)


def test_bpe_stitches_ordinary_texts():
    coder = byte_bpe.coder_of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    r = random.Random(2)
    signs = "abcXYZ01'., \t\n\x0b\x1c\x85\xa0éßΣ日😀ſsStrell"
    for size in (0, 1, 50, 51, 62, 63, 400, 3000):
        text = "".join(r.choice(signs) for _ in range(size))
        parts = list(byte_bpe.stitched(text, coder.pretokens, 50, 12))
        assert [t for p in parts for t in p] == coder.pretokens(text)
        assert size < 63 or len(parts) > 1
    assert len(list(byte_bpe.stitched("some ordinary words " * 300, coder.pretokens))) == 3
    long = "a" * 500 + " b" * 200
    assert [t for p in byte_bpe.stitched(long, coder.pretokens, 50, 12) for t in p] == coder.pretokens(long)


def test_mix_meets_its_targets(spark):
    got = mixing.mixed(sample_docs(spark)).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(rows[0]["target"] for rows in by.values()) - total) < 1e-6 * total
    for rows in by.values():
        assert rows[0]["target"] <= 3 * rows[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
        assert all(0 <= r["copies"] <= 3 for r in rows)
    odd = mixing.mixed(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) * 2 and all(r["size"] == len(WORDS.findall(ODD[0] or "")) for r in odd if r["doc_id"] == 0)
    assert mixing.mixed(empty_docs(spark)).count() == 0


def test_language_on_the_held_out_fold(spark):
    df = language.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in df) >= 0.97 * len(df)
    odd = language.identify(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) * 2
    assert {r["lang_pred"] for r in language.identify(empty_docs(spark).union(odd_docs(spark).where("lang is null"))).collect()} == {"und"}


def test_language_predictions_match_brute_force(spark):
    docs = sample_docs(spark)
    model = language.learn_languages(docs)

    def vector(text):
        raw, counts = text.lower().encode(), np.zeros(language.N_FEATURES)
        for n in range(1, 5):
            for i in range(len(raw) - n + 1):
                g = n
                for b in raw[i : i + n]:
                    g = (g * 257 + b) % 2**32
                counts[g * 2654435761 % 2**32 >> 20] += 1
        return np.append((np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))).astype(np.float32), 1.0)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identify(docs).where("doc_id % 9 = 0").collect():
        if not re.search(r"[^\W\d_]", texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        v = vector(texts[r["doc_id"]])
        margins = model.first @ v
        members = model.members[model.families[int(margins.argmax())]]
        wins = {n: 0 for n in members}
        for (a, b), w in model.pairs.items():
            if a in wins:
                wins[a if w @ v >= 0 else b] += 1
        assert wins[r["lang_pred"]] == max(wins.values()) and 0 <= r["score"] <= 1


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_fixture():
    rng, docs = random.Random(9), []
    for base in range(12):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(12):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = f"v{rng.randint(0, 10**6)}"
            docs.append(" ".join(x).upper() if rng.random() < 0.2 else "\n".join(x))
    return docs + ["", None, "a b", "A  b", "c"]


def test_near_duplicates_match_brute_force(spark):
    docs = near_fixture()
    sets = [shingle_set(t) for t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for i in range(len(docs)):
        assert got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == find(i) and got[i]["kept"] == (find(i) == i)


def family_fixture(rng, rows, pairs, common, own, shared):
    """Lists of words: a common passage and one of their own; of the first rows, pairs (2 i, 2 i + 1) share the start of theirs."""
    passage, docs = [f"c{rng.randrange(10**9)}" for _ in range(common)], []
    for i in range(rows):
        mine = [f"u{rng.randrange(10**9)}" for _ in range(own)]
        if i % 2 and i < 2 * pairs:
            mine[:shared] = docs[-1][common : common + shared]
        docs.append(passage + mine)
    return docs


def test_near_duplicates_lose_no_single_link_in_a_dense_family(spark, monkeypatch):
    docs = family_fixture(random.Random(3), 600, 100, 200, 20, 4)
    sets = [shingle_set(" ".join(x)) for x in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert len(set(group)) == 500
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 150)
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == dict(enumerate(group))


def test_near_duplicates_over_more_partitions_than_rows(spark):
    docs = near_fixture()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_near_duplicates_odd_inputs(spark):
    odd = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) * 2 and all(r["kept"] for r in odd if r["doc_id"] is None)
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 110: 100, 120: 100}


def lm_docs(spark):
    return spark.createDataFrame([(i, ("the cat sat on the mat . " if i % 2 else "le chat noir dort bien . ") * 30 + f"rareWord{i}") for i in range(60)], "doc_id long, text string")


def test_masked_lm_scores_match_brute_force(spark):
    docs = lm_docs(spark)
    counts = masked_lm.word_counts(docs)
    known = masked_lm.known_words(counts, 9)
    spelled = masked_lm.spelling(counts, known)
    tokens = masked_lm.written(docs.mapInArrow(masked_lm._to_ids(known, spelled), "doc_id long, ids binary, spelled double"), "ids")
    flat = masked_lm.train(masked_lm.shards(tokens))
    p = masked_lm.unpacked(flat)
    log = lambda z, i: float(z[i] - np.log(np.exp(z.astype(float)).sum()))
    got = {r["doc_id"]: r["log_prob"] for r in tokens.mapInArrow(masked_lm._score(flat), "doc_id long, n_tokens long, log_prob double").collect()}
    for r in docs.where("doc_id < 4").collect():
        w = r["text"].lower().split()
        ids = [known.index(x) if x in known else masked_lm.KNOWN + x.encode()[0] for x in w]
        at = lambda i: ids[i] if 0 <= i < len(ids) else masked_lm.PAD
        total = 0.0
        for i, x in enumerate(w):
            h = np.tanh(p["b"] + sum(p["e"][at(i + k)] @ p["w"][j] for j, k in enumerate(masked_lm.PLACES)))
            c, n = divmod(ids[i], masked_lm.WITHIN)
            total += log(h @ p["c"] + p["cb"], c) + log(h @ p["o"][c] + p["ob"][c], n)
            if x not in known:
                context, symbol, _ = masked_lm.spelling_steps([x.encode()])
                assert len(symbol) == len(x) and symbol[-1] == masked_lm.END
                total += sum(float(spelled[a, b]) for a, b in zip(context, symbol))
        assert abs(total - got[r["doc_id"]]) < 1e-3 * abs(total)


def test_masked_lm_learns_and_takes_odd_inputs(spark):
    out = masked_lm.lm_scores(lm_docs(spark)).collect()
    assert all(r["n_tokens"] in (181, 211) and r["per_token"] > -0.8 * np.log(masked_lm.VOCABULARY) for r in out)
    odd = masked_lm.lm_scores(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) * 2 and all(r["log_prob"] == 0 for r in odd if r["n_tokens"] == 0)
    assert masked_lm.lm_scores(empty_docs(spark)).count() == 0


def test_masked_lm_does_not_depend_on_partitions(spark):
    docs = sample_docs(spark)
    a, b = ({r["doc_id"]: r["log_prob"] for r in masked_lm.lm_scores(d).collect()} for d in (docs, docs.repartition(7)))
    assert all(abs(a[i] - b[i]) <= 1e-4 * max(1, abs(a[i])) for i in a)


def test_masked_lm_trains_every_position_once():
    padded = np.concatenate([[masked_lm.PAD] * 2, np.arange(50), [masked_lm.PAD] * 2])
    assert sum(masked_lm.train_shard(masked_lm.start_parameters(), padded, t)[1] for t in range(masked_lm.ROUNDS)) == 50


def test_masked_lm_probabilities_sum_to_one():
    p = masked_lm.start_parameters()
    padded = np.concatenate([[masked_lm.PAD] * 2, [5, 9, 700], [masked_lm.PAD] * 2]).astype(np.int64)
    total = 0.0
    for token in range(masked_lm.VOCABULARY):
        padded[3] = token
        total += float(np.exp(masked_lm.log_probabilities(p, padded, np.array([3]))[0]))
    assert abs(total - 1) < 1e-3


def test_spelling_sums_to_one(spark):
    counts = masked_lm.word_counts(lm_docs(spark))
    assert np.allclose(np.exp(masked_lm.spelling(counts, ["the"])).sum(1), 1, atol=1e-4)
    context, symbol, owner = masked_lm.spelling_steps([b"ab", b"c"])
    assert symbol.tolist() == [98, 256, 256] and owner.tolist() == [0, 0, 1]


def test_line_dedup_matches_brute_force(spark):
    rng, lines = random.Random(4), []
    for _ in range(12):
        w = [f"word{rng.randint(0, 900)}" for _ in range(40)]
        for _ in range(rng.choice((1, 3, 25))):
            x = list(w)
            if rng.random() < 0.7:
                x[rng.randrange(40)] += "s"
            lines.append("  ".join(x) if rng.random() < 0.3 else " ".join(x).title())
    rng.shuffle(lines)
    texts = ["\n".join(["", *lines[i : i + 4], " "]) for i in range(0, len(lines), 4)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    found = line_dedup.occurrences(docs).collect()
    norm = {(r["k_id"], r["line_no"]): " ".join(WORDS.findall(texts[r["k_id"]].split("\n")[r["line_no"]].lower())) for r in found}
    keys = sorted(set(norm.values()))
    group = {k: k for k in keys}
    frame = pd.DataFrame({"k": keys})  # noqa: F841
    near = "levenshtein(x.k, y.k) <= floor(0.2 * greatest(length(x.k), length(y.k)) + 1e-9)"
    for a, b in duckdb.sql(f"SELECT x.k, y.k FROM frame x JOIN frame y ON x.k < y.k WHERE {near}").fetchall():
        old, new = group[a], group[b]
        group = {k: new if g == old else g for k, g in group.items()}
    first = {}
    for place in sorted(norm):
        first.setdefault(group[norm[place]], place)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        assert out[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in norm or first[group[norm[i, n]]] == (i, n))


def test_line_dedup_finds_edit_similar_lines(spark):
    """Against all pairs of the sample's lines with an edit similarity of 0.8 or more; bigrams rule the others out (an edit changes four at most)."""
    found = line_dedup.occurrences(sample_docs(spark)).select("key", "norm").distinct().collect()
    lines = sorted(found, key=lambda r: len(r["norm"]))
    grams = np.zeros((len(lines), 256), np.int16)
    for i, r in enumerate(lines):
        for a, b in zip(r["norm"], r["norm"][1:]):
            grams[i, zlib.crc32((a + b).encode()) % 256] += 1
    sizes, pairs = np.array([len(r["norm"]) for r in lines]), []
    for i in range(len(lines)):
        ahead = slice(i + 1, int(np.searchsorted(sizes, sizes[i] / 0.8 + 1e-9, side="right")))
        near = np.abs(grams[ahead] - grams[i]).sum(1) <= 4 * np.floor(0.2 * sizes[ahead] + 1e-9)
        pairs += [(lines[i], lines[j]) for j in np.flatnonzero(near) + i + 1]
    frame = spark.createDataFrame([(a["key"], b["key"], a["norm"], b["norm"]) for a, b in pairs], "a long, b long, x string, y string")
    truth = frame.where(F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * 0.2 + 1e-9)).select("a", "b").collect()
    found = line_dedup.written(line_dedup.occurrences(sample_docs(spark)), "occurrences")
    group = {r["node"]: r["component"] for r in line_dedup.line_groups(found, 0.8).collect()}
    assert len(truth) > 30 and sum(group.get(r["a"], r["a"]) == group.get(r["b"], r["b"]) for r in truth) >= 0.9 * len(truth)


def grouped_lines(spark, lines):
    keyed = spark.createDataFrame([(x,) for x in lines], "norm string").select(F.xxhash64("norm").alias("key"), "norm")
    keys = {r["norm"]: r["key"] for r in keyed.collect()}
    group = {r["node"]: r["component"] for r in line_dedup.line_groups(line_dedup.written(keyed, "lines"), 0.8).collect()}
    return {x: group.get(k, k) for x, k in keys.items()}


def edit_similar(spark, lines):
    x = spark.createDataFrame([(x,) for x in sorted(set(lines))], "x string").repartition(8)
    both = x.join(x.withColumnRenamed("x", "y"), F.col("x") < F.col("y"))
    return [tuple(r) for r in both.where(F.levenshtein("x", "y") <= F.floor(0.2 * F.greatest(F.length("x"), F.length("y")) + 1e-9)).collect()]


def test_tiny_lines_are_linked_without_exception(spark):
    rng = random.Random(11)
    lines = {"".join(rng.choice("abc ") for _ in range(n)).strip() or "x" for n in range(1, 15) for _ in range(25)}
    lines |= {x[:i] + rng.choice(["", "é", "zz"]) + x[i + 1 :] or "y" for x in sorted(lines) for i in [rng.randrange(len(x))]}
    lines = sorted({" ".join(x.split()) or "x" for x in lines if len(x.strip()) <= 14})
    group = grouped_lines(spark, lines)
    want = {x: x for x in lines}
    for a, b in edit_similar(spark, lines):
        old, new = want[a], want[b]
        want = {k: new if g == old else g for k, g in want.items()}
    assert len(set(want.values())) > 20 and len(set(group.values())) == len(set(want.values())) == len({(group[x], want[x]) for x in lines})


def test_line_recall_in_each_class_of_length(spark):
    """Families of unlike lines with one to three edits of any kind: a changed, added or lost word, letters, marks behind words; also a script without spaces."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 9))))
    lines = set()
    for n in (4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 25, 32, 45, 60):
        for f in range(12):
            w = [chr(0x4E00 + rng.randrange(3000)) for _ in range(3 * n)] if f == 0 else [word() for _ in range(n)]
            for _ in range(3):
                x = list(w)
                for _ in range(rng.randint(0, 1 if n < 8 else 2)):
                    i = rng.randrange(len(x))
                    x[i : i + 1] = rng.choice(([word()], [x[i], word()[:3]], [], [x[i] + ","], [x[i][1:] + "z"]))
                lines.add(("" if f == 0 else " ").join(x).strip())
    group, found, pairs = grouped_lines(spark, lines), {}, edit_similar(spark, lines)
    for a, b in pairs:
        upto = next(x for x in (39, 59, 99, 139, 249, 9999) if max(len(a), len(b)) <= x)
        hit, of = found.get(upto, (0, 0))
        found[upto] = (hit + (group[a] == group[b]), of + 1)
    assert len(found) == 6 and all(of >= 20 and hit >= 0.9 * of for hit, of in found.values()), found
    # groups hold what a chain of alike lines connects, and no more
    want = {x: x for x in lines}
    for a, b in pairs:
        old, new = want[a], want[b]
        want = {k: new if g == old else g for k, g in want.items()}
    assert all(len({want[x] for x in lines if group[x] == g}) == 1 for g in set(group.values()))


def test_similar_pairs_are_exact(spark):
    rng, rows = random.Random(8), []
    for _ in range(400):
        w = ["".join(rng.choice("abé日") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice((1, 3, 12, 90)))]
        x = list(w)
        for _ in range(rng.randint(0, max(1, len(w) // 4))):
            at = rng.randrange(len(x)) if x else 0
            x[at : at + rng.randint(0, 1)] = [] if rng.random() < 0.3 and len(x) > 1 else ["".join(rng.choice("abé日") for _ in range(rng.randint(1, 9)))]
        rows.append((" ".join(w), " ".join(x)))
    both = spark.createDataFrame(rows, "a_norm string, b_norm string").distinct()
    allowed = F.floor(F.greatest(F.length("a_norm"), F.length("b_norm")) * 0.2 + 1e-9)
    want = sorted(map(tuple, both.where(F.levenshtein("a_norm", "b_norm") <= allowed).collect()))
    assert 50 < len(want) < 390 and sorted(map(tuple, line_dedup.similar_pairs(both, 0.8).collect())) == want


def test_simhash_is_the_majority_of_bits(spark):
    words = [f"word{i}" for i in range(9)]
    lines = spark.createDataFrame([(1, " ".join(words))], "key long, norm string").repartition("key")
    got = {r["bucket"] for r in line_dedup.block_keys(lines, 3, 0.8).collect()}
    h = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").withColumn("h", F.xxhash64("w")).collect()}
    want = []
    for slot, (a, b) in enumerate(line_dedup.combinations(range(6), 2)):
        some = [h[w] for w in words if h[w] % 6 in (a, b)]
        if len(some) >= 3:
            want.append((slot, len(some), sum(1 << i for i in range(60) if i % 12 < 8 and 2 * sum(x >> i & 1 for x in some) > len(some))))
    expected = spark.createDataFrame(want, "slot int, n long, sim long").select(F.xxhash64("slot", "n", "sim").alias("b")).collect()
    assert want and got == {r["b"] for r in expected}


def test_only_lines_of_pairs_are_shuffled(spark, monkeypatch):
    """The bitmap of the pairs' keys is looked up before any join that shuffles lines, and the texts are those of the pairs."""
    found = line_dedup.written(line_dedup.occurrences(sample_docs(spark)), "occurrences")
    keys = [r["key"] for r in found.select("key").distinct().orderBy("key").limit(40).collect()]
    pairs = line_dedup.written(spark.createDataFrame(list(zip(keys[::2], keys[1::2])), "a long, b long"), "pairs")
    seen, write = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, **k: seen.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), out := write(df, name, **k), out.collect() if name == "texts" else None))[1])
    line_dedup._verified(found, pairs, 0.8)
    plan, _, rows = seen["texts"]
    assert "getbit" in plan and "LeftSemi" not in plan[plan.index("getbit") :]
    assert sorted(r["key"] for r in rows) == keys and {(r["key"], r["norm"]) for r in rows} <= {(r["key"], r["norm"]) for r in found.collect()}


def test_line_dedup_carries_clashing_columns(spark):
    names = ["drop", "k_id", "k_text", "line_no", "key", "n_lines"]
    docs = spark.createDataFrame([(i, "same line here\nown line number %d of these" % i, *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [[r[n] for n in names[:-1]] for r in out] == [names[:-1]] * 3 and [r["n_lines"] for r in out] == [2] * 3 and [r["n_dropped"] for r in out][1] >= 1


def test_line_dedup_odd_inputs(spark):
    out = line_dedup.dedup_lines(odd_docs(spark)).collect()
    assert len(out) == len(ODD) * 2 and all(r["text"] is None for r in out if r["n_lines"] == 0 and r["doc_id"] == 0)
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_pipeline_takes_odd_documents(spark):
    import corpus_pipeline

    odd = odd_docs(spark).unionByName(odd_docs(spark))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty_docs(spark)):
            out = stage(spark, docs, SF)
            assert docs is odd or out.count() == 0
            assert name == "byte_bpe" or (out.columns == corpus_pipeline.COLUMNS and out.schema["text"].dataType.simpleString() == "string" and out.count() <= 3 * docs.count())


def test_two_runs_do_not_disturb_each_other(spark):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, first.collect())) == sorted(map(key, second.collect()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = sample_docs(spark).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(out) == docs.count() and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)


def test_near_stage_keeps_different_texts_of_an_id(spark):
    import corpus_pipeline

    rows = [(1, "first text of one id", "en", "a", 20), (1, "something else that stands under it", "en", "a", 35), (1, "first text of one id", "en", "a", 20), (2, "third", "en", "b", 5)]
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(map(tuple, out)) == sorted(set(rows))


def test_least_prefix_follows_the_similarity():
    for percent in (70, 80, 85, 90):
        assert (1 - (percent / 100) ** near_dedup.least_prefix(percent)) ** near_dedup.TREES <= near_dedup.MISS
    assert near_dedup.least_prefix(85) == near_dedup.LEAST_PREFIX


def test_keys_of_lines_need_no_second_shuffle(spark):
    lines = spark.createDataFrame([(i, f"some line number {i} of these") for i in range(40)], "key long, norm string").repartition(3, "key")
    keys = line_dedup.block_keys(lines, 3, 0.8, few=True)
    assert keys.count() > 40 and keys._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_far_is_no_less_than_the_distance(spark):
    """Long lines with shifts, so that pieces do not lie on pieces; what is told unlike by a window alone is unlike."""
    rng, rows = random.Random(21), []
    for i in range(120):
        x = [rng.choice("abcé ") for _ in range(rng.choice((30, 300, 700, 1500)))]
        y = list(x) if i % 4 else [rng.choice("abcé ") for _ in x]
        for _ in range(rng.randint(1, max(1, len(x) // 6))):
            at = rng.randrange(len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(("", "z", "日z"))
        rows.append(("".join(x), "".join(y)))
    both = spark.createDataFrame(rows, "a_norm string, b_norm string").distinct().withColumn("d", F.levenshtein("a_norm", "b_norm"))
    allowed = F.floor(F.greatest(F.length("a_norm"), F.length("b_norm")) * 0.2 + 1e-9)
    want = {r["a_norm"]: r["d"] for r in both.where(F.col("d") <= allowed).collect()}
    got = {r["a_norm"]: r["far"] for r in line_dedup.measured_pairs(both, 0.8).where(F.col("far") <= allowed).collect()}
    assert 40 < len(want) < 110 and got.keys() == want.keys() and all(got[k] >= want[k] for k in want) and any(got[k] > want[k] for k in want)


def test_a_family_of_unlike_lines_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Two groups of 60 lines that share a third of their words and stand 0.5 apart: before, each line of one was compared with each of the other."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(8))
    common, lines = [word() for _ in range(30)], []
    for own in ([word() for _ in range(30)], [word() for _ in range(30)]):
        for i in range(60):
            x = common + own
            x[rng.randrange(30) + 30] = word()
            lines.append(" ".join(x))
    compared, measured = [], line_dedup.measured_pairs
    monkeypatch.setattr(line_dedup, "measured_pairs", lambda both, s: (compared.append(both.select("a", "b").collect()), measured(both, s))[1])
    group, pairs = grouped_lines(spark, lines), edit_similar(spark, lines)
    assert all(group[a] == group[b] for a, b in pairs) and len(set(group.values())) == 2
    assert sum(map(len, compared)) < 600
