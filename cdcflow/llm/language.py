"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Texts are vectors of hashed byte n-grams (1 to 4 bytes of the text lower-cased, N_FEATURES buckets, square roots of counts, unit length), made from
the whole text in numpy inside tasks. Families group related languages by a fixed table; a language that the table doesn't have is a family of
its own. A linear one-versus-rest machine picks the family, then each pair of languages in it votes.

Training takes a bounded sample: per_language training rows of each language (all languages, with fewer rows each where that would pass max_rows), those
whose ids hash lowest in each of SALTS buckets. Scoring covers every row.

Defined cases: a text that is null or has no letters is `und` with score 0; with no training rows at all everything is `und`; null ids are in no held-out
fold and are not learned from; repeated rows get equal results each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

N_FEATURES = 4096
SALTS = 32  # buckets of ids that a language's training rows are drawn from alike, so that no task sorts a whole language
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "si"),
    "sinitic": ("zh", "yue"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of a text's hashed n-grams."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(N_FEATURES)
    for n in range(1, 5):
        if len(raw) < n:
            break
        grams = np.full(len(raw) - n + 1, n, np.uint32)
        for i in range(n):
            grams = grams * np.uint32(257) + raw[i : len(raw) - n + 1 + i]
        counts += np.bincount(grams * np.uint32(2654435761) >> np.uint32(20), minlength=N_FEATURES)
    counts = np.sqrt(counts)
    return (counts / max(1e-12, np.sqrt(counts @ counts))).astype(np.float32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [features(t.as_py() or "").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary())], names=["lang", "x"])


def svm(x: np.ndarray, sign: np.ndarray, rounds: int = 100, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) of a linear machine with squared hinge loss, by accelerated full-batch descent; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    sign = sign.astype(x.dtype)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    w = back = np.zeros(x.shape[1], x.dtype)
    for t in range(rounds):
        ahead = w + x.dtype.type(t / (t + 3)) * (w - back)
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        step = 2 * ((weight * sign * slack) @ x) - 2 * penalty * ahead
        w, back = (ahead + 0.25 * step).astype(x.dtype), w
    return w


class Hierarchy:
    """The learned machines, some numbers for each pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names, families = sorted(set(langs)), sorted({family_of(n) for n in langs})
        of, has = np.array(langs), np.array([family_of(n) for n in langs])
        self.families = families
        self.members = {f: [n for n in names if family_of(n) == f] for f in families}
        self.first = np.array([svm(x, np.where(has == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else None
        self.pairs = {}
        for f in families:
            for a, b in combinations(self.members[f], 2):
                rows = (of == a) | (of == b)
                self.pairs[a, b] = svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language and how sure: the product of the logistic values of the two steps' margins."""
        v, score, family = np.append(v, 1.0), 1.0, self.families[0]
        if self.first is not None:
            margins = self.first @ v
            best = int(margins.argmax())
            family, score = self.families[best], 1 / (1 + np.exp(-3 * float(margins[best])))
        members = self.members[family]
        if len(members) == 1:
            return members[0], score
        votes, margin = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            m = float(self.pairs[a, b] @ v)
            votes[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(members, key=lambda n: (votes[n], margin[n], n))
        return best, score / (1 + np.exp(-3 * margin[best] / (len(members) - 1)))


def _predict(model: Hierarchy | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found.append(model.predict(features(text)) if model and letter.search(text) else (UNKNOWN, 0.0))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([float(f[1]) for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def learn_languages(docs: DataFrame, per_language: int = 600, max_rows: int = 12_000) -> Hierarchy | None:
    """Learn from at most per_language rows of each language, outside the held-out fold, or fewer alike if there are so many languages that max_rows would be passed."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    each = max(1, min(per_language, max_rows // max(1, known.select("lang").distinct().count())))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    ordered = Window.partitionBy("lang", "salt").orderBy("place", "doc_id")
    chosen = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("place"), salt.alias("salt")).withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= -(-each // SALTS))
    chosen = chosen.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), 1, each).alias("rows"))  # each + SALTS rows at most
    chosen = chosen.select("lang", F.explode("rows.doc_id").alias("doc_id")).distinct()
    sample = docs.select("lang", "doc_id", "text").where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(chosen), ["lang", "doc_id"])  # max_rows rows, or one a language
    sample = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # of rows that share an id, one
    rows = sample.select("lang", "text").mapInArrow(_featurise, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Hierarchy(np.array([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = learn_languages(docs, per_language)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
