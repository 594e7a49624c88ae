"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from the SIDE tokens on its left and on its right: each context token's embedding is projected by its place, the sum goes
through tanh, and a two-level softmax gives the token's class and then the token within its class. A document's score is the sum
of its tokens' conditional log-probabilities.

Tokens are words. The KNOWN most frequent ones are predicted as such; any other word is predicted as its first byte and then spelled: each further byte, and
the end, has a probability given the two bytes before, from counts over the corpus. So every word has a probability of its own. (What the spelling
gives to known words is left unused.)

What is gathered from the corpus covers all of it and grows with it: the count of every distinct word, which gives the known words and the spelling, and the
training, which visits every position of every document once, over ROUNDS rounds. Documents are dealt by a hash of their content to shards of about
SHARD_TOKENS tokens, each shard is trained by itself in numpy, in an order that its content fixes, and the shards' parameters are averaged in
whole numbers, so the result doesn't depend on how rows lie in partitions. The driver holds the network and the spelling, of fixed size.

Defined cases: words are runs of characters other than ASCII white space, lower-cased; a null or empty text has no tokens and scores 0; repeated rows and
null ids are scored row by row; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, table, temporaries, words, written

CLASSES, WITHIN = 40, 40
VOCABULARY = CLASSES * WITHIN
KNOWN = VOCABULARY - 256  # the others stand for words that begin with a byte
PAD = VOCABULARY
SIDE = 2
DIM, HIDDEN = 16, 32
ROUNDS = 4
BATCH = 4096
SHARD_TOKENS = 1 << 20
SEGMENT = 1 << 16  # tokens of a document that go to a shard together
SCALE = 1 << 24  # of the whole numbers that parameters are summed as
CONTEXTS, END, SMOOTH = 4096, 256, 8.0  # of the spelling
REMEMBERED = 200_000  # words
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
SHAPES = {"e": (VOCABULARY + 1, DIM), "w": (len(PLACES), DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES, HIDDEN, WITHIN), "ob": (CLASSES, WITHIN)}


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of the corpus occurs; written."""
    each = docs.select(F.explode(words(F.lower("text"))).alias("word"))
    return written(each.groupBy("word").agg(F.count("*").alias("n")), "counts")


def known_words(counts: DataFrame, known: int = KNOWN) -> list[str]:
    """The most frequent words, ties in their order."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(known).collect()]


def spelling_steps(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the context and the symbol of each byte after the first, and of the end, and the number of its word."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    symbol = flat.copy()
    symbol[first + sizes] = END
    before = np.concatenate([[0], flat[:-1]])
    second = np.concatenate([[0, 0], flat[:-2]])[: len(flat)]
    second[np.minimum(first + 1, len(flat) - 1)] = 256  # words have a byte at least, so this is never a first one
    later = np.ones(len(flat), bool)
    later[first] = False
    context = (before * 257 + second) * 40503 % (1 << 24) * CONTEXTS >> 24
    return context[later], symbol[later], owner[later]


def _spelled_counts(known: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, total = set(known), np.zeros(CONTEXTS * 257, np.int64)
        for batch in batches:
            pairs = [(w.encode("utf-8", "surrogatepass"), n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) if w not in skip]
            if pairs:
                context, symbol, owner = spelling_steps([p[0] for p in pairs])
                np.add.at(total, context * 257 + symbol, np.array([p[1] for p in pairs])[owner])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return run


def spelling(counts: DataFrame, known: list[str]) -> np.ndarray:
    """Log-probabilities of symbols by context."""
    cells = counts.mapInArrow(_spelled_counts(known), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CONTEXTS * 257 rows at most
    n = np.zeros(CONTEXTS * 257)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(CONTEXTS, 257)
    base = (n.sum(0) + 1) / (n.sum() + 257)
    return np.log((n + SMOOTH * base) / (n.sum(1, keepdims=True) + SMOOTH)).astype(np.float32)


class Ids(dict):
    """Rows of words in the arrays ids and logs (of their spelling); words that it hasn't seen get the next rows when they are looked up, and learn() fills these."""

    def __init__(self, known: list[str], spelled: np.ndarray):
        self.known, self.spelled = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(known)}, spelled
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(self.known)
        self.fresh: list[bytes] = []
        self.ids, self.logs = np.arange(len(self.known)), np.zeros(len(self.known))

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        row = self[word] = len(self)
        return row

    def learn(self) -> None:
        if self.fresh:
            context, symbol, owner = spelling_steps(self.fresh)
            logs = np.bincount(owner, weights=self.spelled[context, symbol], minlength=len(self.fresh))
            self.ids = np.concatenate([self.ids, KNOWN + np.fromiter((p[0] for p in self.fresh), np.int64, len(self.fresh))])
            self.logs = np.concatenate([self.logs, logs])
            self.fresh = []


def _to_ids(known: list[str], spelled: np.ndarray):
    """text -> doc_id, ids and spelled, the log-probability of what isn't known beyond its first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Ids(known, spelled)
        for batch in batches:
            out, logs = [], []
            for start in range(0, batch.num_rows, 500):
                if len(place) > REMEMBERED:
                    place.forget()
                split = [(t.as_py() or "").lower().encode("utf-8", "surrogatepass").split() for t in batch.column("text").slice(start, 500)]
                rows = [np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces)) for pieces in split]
                place.learn()
                out += [place.ids[r].astype("<u2").tobytes() for r in rows]
                logs += [float(place.logs[r].sum()) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(logs, pa.float64())], names=["doc_id", "ids", "spelled"])

    return run


def start_parameters() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    return {k: np.zeros(s, np.float32) if k in ("b", "cb", "ob") else rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def _in_classes(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts targets of one class side by side, and where the classes begin and end in it."""
    classes = (targets // WITHIN).astype(np.uint8)
    return np.argsort(classes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES))])


def projected(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each token adds to the hidden layer, by place."""
    return [p["e"] @ p["w"][j] for j in range(len(PLACES))]


def _hidden(p: dict[str, np.ndarray], adds: list[np.ndarray], padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = adds[0][padded[at + PLACES[0]]]
    for add, k in zip(adds[1:], PLACES[1:]):
        h += add[padded[at + k]]
    h += p["b"]
    return np.tanh(h, out=h)


def log_probabilities(p: dict[str, np.ndarray], padded: np.ndarray, at: np.ndarray, adds: list[np.ndarray] | None = None) -> np.ndarray:
    """Of the tokens at the places at of padded, from both sides."""
    order, ends = _in_classes(padded[at])
    at = at[order]
    h, targets = _hidden(p, adds or projected(p), padded, at), padded[at]
    z, row = h @ p["c"] + p["cb"], np.arange(len(at))
    told = z[row, targets // WITHIN] - np.log(np.exp(z, out=z).sum(1))  # weights are small, so nothing overflows
    z = np.empty((len(at), WITHIN), np.float32)
    for c in range(CLASSES):
        part = slice(ends[c], ends[c + 1])
        np.matmul(h[part], p["o"][c], out=z[part])
        z[part] += p["ob"][c]
    told += z[row, targets % WITHIN] - np.log(np.exp(z, out=z).sum(1))
    out = np.empty(len(at), np.float32)
    out[order] = told
    return out


class Trainer:
    """Adagrad on batches of positions."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.1):
        self.p, self.rate = {k: v.copy() for k, v in p.items()}, np.float32(rate)
        self.seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}

    def step(self, padded: np.ndarray, at: np.ndarray) -> None:
        p, n = self.p, len(at)
        g = {k: np.zeros_like(p[k]) for k in ("w", "o", "ob")}
        order, ends = _in_classes(padded[at])
        at = at[order]
        h, targets, row = _hidden(p, projected(p), padded, at), padded[at], np.arange(n)

        def softmax(z: np.ndarray) -> np.ndarray:
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            return z

        d = softmax(h @ p["c"] + p["cb"])
        d[row, targets // WITHIN] -= 1
        g["c"], g["cb"], dh = h.T @ d, d.sum(0), d @ p["c"].T
        z = np.empty((n, WITHIN), np.float32)
        for c in range(CLASSES):
            part = slice(ends[c], ends[c + 1])
            np.matmul(h[part], p["o"][c], out=z[part])
            z[part] += p["ob"][c]
        d = softmax(z)
        d[row, targets % WITHIN] -= 1
        for c in range(CLASSES):
            part = slice(ends[c], ends[c + 1])
            g["o"][c], g["ob"][c] = h[part].T @ d[part], d[part].sum(0)
            dh[part] += d[part] @ p["o"][c].T
        dh *= 1 - h * h
        g["b"] = dh.sum(0)
        context = np.concatenate([padded[at + k] for k in PLACES])
        back = np.ascontiguousarray(np.concatenate([p["w"][j] @ dh.T for j in range(len(PLACES))], axis=1))
        for j in range(len(PLACES)):
            g["w"][j] = p["e"][context[j * n : (j + 1) * n]].T @ dh
        g["e"] = np.stack([np.bincount(context, weights=b, minlength=VOCABULARY + 1) for b in back], axis=1).astype(np.float32)
        for k in p:
            grad = g[k] / np.float32(n)
            self.seen[k] += grad * grad
            p[k] -= self.rate * grad / np.sqrt(self.seen[k])


def _pack(rows: pa.Table) -> pa.Table:
    """The segments of a shard as one row: shard, tokens (SIDE pads around each segment)."""
    gap = np.full(SIDE, PAD, "<u2").tobytes()
    order = sorted(zip(rows["h"].to_pylist(), rows["ids"].to_pylist()))
    return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int64()), "tokens": pa.array([gap + b"".join(ids + gap for _, ids in order)], pa.binary())})


def shards(tokens: DataFrame) -> DataFrame:
    """shard, tokens: all documents, in shards that their number of tokens and their content fix; written."""
    total = tokens.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    n = max(1, -(-int(total) // SHARD_TOKENS))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("ids") - 1) / (2 * SEGMENT)).cast("int"))
    parts = tokens.where(F.octet_length("ids") > 0).select("doc_id", "ids", F.explode(starts).alias("part"))
    parts = parts.select(F.xxhash64("doc_id", "part", "ids").alias("h"), F.substring(F.col("ids"), F.col("part") * (2 * SEGMENT) + 1, F.lit(2 * SEGMENT)).alias("ids"))
    dealt = parts.withColumn("shard", F.pmod("h", F.lit(n)))
    return written(dealt.groupBy("shard").applyInArrow(_pack, "shard long, tokens binary"), "shards")


def train_shard(p: dict[str, np.ndarray], padded: np.ndarray, turn: int) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after every ROUNDS-th position, from the turn-th on, and how many positions that were."""
    at = np.flatnonzero(padded != PAD)[turn::ROUNDS]
    trainer = Trainer(p)
    for start in range(0, len(at), BATCH):
        trainer.step(padded, at[start : start + BATCH])
    return trainer.p, len(at)


def _train(flat: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = 0, np.zeros(len(flat), np.int64)
        for batch in batches:
            for raw in batch.column("tokens"):
                p, n = train_shard(unpacked(flat), np.frombuffer(raw.as_py(), "<u2").astype(np.int64), turn)
                weight = n / SHARD_TOKENS
                weights += round(weight * SCALE)
                total += np.rint(packed(p).astype(float) * (weight * SCALE)).astype(np.int64)
        if weights:
            yield pa.RecordBatch.from_arrays([pa.array([weights]), pa.array([total], pa.list_(pa.int64()))], names=["n", "p"])

    return run


def train(packs: DataFrame) -> np.ndarray:
    """Parameters after ROUNDS rounds of training by shard and averaging; packs: as shards() gives them."""
    flat = packed(start_parameters())
    for turn in range(ROUNDS):
        local = packs.select("tokens").mapInArrow(_train(flat, turn), "n long, p array<bigint>")
        each = local.select("n", F.posexplode("p").alias("i", "v"))
        mean = each.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()  # as many rows as the network has parameters
        if len(mean):
            flat[mean["i"].to_numpy()] = mean["v"].to_numpy()
    return flat


def padded_runs(column, most: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Documents side by side with SIDE pads around each: (tokens, places, the document of each place, first row, rows), most tokens or one document at a time."""
    start, size, parts = 0, 0, []
    for i, raw in enumerate(column):
        parts.append(np.frombuffer(raw.as_py(), "<u2").astype(np.int64))
        size += len(parts[-1])
        if size >= most or i == len(column) - 1:
            sizes = np.array([len(x) for x in parts])
            gap = np.full(SIDE, PAD)
            padded = np.concatenate([gap, *(y for x in parts for y in (x, gap))])
            owner = np.repeat(np.arange(len(parts)), sizes)
            yield padded, np.arange(size) + SIDE + owner * SIDE, owner, start, len(parts)
            start, size, parts = i + 1, 0, []


def _score(flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpacked(flat)
        adds = projected(p)
        for batch in batches:
            sums, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for padded, at, owner, start, n in padded_runs(batch.column("ids")):
                for s in range(0, len(at), 8_192):
                    part = slice(s, s + 8_192)
                    sums[start : start + n] += np.bincount(owner[part], weights=log_probabilities(p, padded, at[part], adds), minlength=n)
                sizes[start : start + n] = np.bincount(owner, minlength=n)
            sums += batch.column("spelled").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums)], names=["doc_id", "n_tokens", "log_prob"])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and per_token (0 without tokens) for every row of docs."""
    rows = docs.select("doc_id", "text")
    with temporaries(docs.sparkSession):
        counts = word_counts(rows)
        known = known_words(counts)
        spelled = spelling(counts, known)
        drop_written(counts)
        tokens = written(rows.mapInArrow(_to_ids(known, spelled), "doc_id long, ids binary, spelled double"), "ids", keep=True)
        flat = train(shards(tokens))
    scored = tokens.mapInArrow(_score(flat), "doc_id long, n_tokens long, log_prob double")
    return scored.withColumn("per_token", F.col("log_prob") / F.greatest(F.col("n_tokens"), F.lit(1)))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
