"""Whitens integer vectors by the principal components that the exact characteristic polynomial of their scatter matrix leads to.

1. Sums and products of the components are added up exactly (in limbs of 40 bits), which gives the integer scatter matrix A = n sum(xx') - SS' = n^2 V.
2. The characteristic polynomial of A is made modulo many primes, by reduction to Hessenberg form, one Spark row a prime, and joined by Chinese remaindering.
   The number of primes follows from Hadamard's bound, so its coefficients are exact, and a root of zero shows with its multiplicity.
3. All its roots are real, so Descartes' rule counts those above a point exactly: halving the range isolates the largest roots, and halving by sign refines them.
4. Inverse iteration on A - root in fixed point with some hundred bits, one Spark row a root, gives the null space: one vector, or as many as a root is repeated.

The driver and a task hold matrices of the dimensions and their big numbers, whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite entries take no part; a vector shorter than the longest is filled up with entries of 0.0;
rows without an id take part and keep their null; repeated rows count again; directions of no variance aren't components, so equal vectors,
a single one, or none give no rows; other columns aren't read. Entries must fit 62 bits once scaled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

LIMB = 40  # bits of the parts in which sums travel
APART = 120  # bits below the largest root at which roots still count as different
PRECISE = 300  # bits below the largest root to which a root is known
FIXED = 640  # bits behind the point in inverse iteration


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * c) of each entry, or null where an entry is null or not finite."""
    good = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(good, F.transform(embedding, lambda c: F.floor(c.cast("double") * scale)))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _products(rows: np.ndarray) -> np.ndarray:
    """rows' rows, exactly: in doubles or 64 bits where nothing can be lost, else in Python's integers."""
    most = int(np.abs(rows).max(initial=0)) ** 2 * max(1, len(rows))
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    return rows.astype(kind).T @ rows.astype(kind)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, j, limb, part: sums of a partition's products of entries i and j; the row [1, entries] stands for a vector, so that counts and sums are among them."""
    total = np.zeros((0, 0), object)
    for batch in batches:
        column = batch.column("x")
        width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        rows = np.concatenate([np.ones((len(column), 1), np.int64), _rows(column, width)], axis=1)
        if len(rows):
            made = _products(rows)
            made = made if made.dtype == object else made.astype(np.int64).astype(object)
            if len(made) > len(total):
                total, made = made, total
            total[: len(made), : len(made)] += made
    out: list[tuple[int, int, int, int]] = []
    for i in range(len(total)):
        for j in range(i, len(total)):
            value, limb = abs(int(total[i, j])), 0
            while value or not limb:
                part = value & ((1 << LIMB) - 1)
                out.append((i, j, limb, part if total[i, j] >= 0 else -part))
                value, limb = value >> LIMB, limb + 1
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["i", "j", "limb", "part"])


def exact_moments(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products of vectors (x: array of longs), exactly."""
    parts = vectors.select("x").mapInArrow(_partial, "i long, j long, limb long, part long")
    sums = parts.groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect()  # some rows for each pair of dimensions
    size = 1 + max((r["j"] for r in sums), default=0)
    m = [[0] * size for _ in range(size)]
    for r in sums:
        m[r["i"]][r["j"]] += r["part"] << (LIMB * r["limb"])
    full = [[m[min(i, j)][max(i, j)] for j in range(size)] for i in range(size)]
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def primes(n: int, below: int = 2**31) -> list[int]:
    """The n largest primes below some bound (2^31 at most, so that products fit 64 bits)."""
    small = [p for p in range(2, math.isqrt(below) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    small_primes, out, at = np.array(small), [], below - 1
    while len(out) < n:
        if (at % small_primes).all():
            out.append(at)
        at -= 1
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(z - matrix) modulo p, by falling power."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    n = len(h)
    for m in range(1, n - 1):  # to Hessenberg form, by similar matrices
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        h[[m, pivot]], h[:, [m, pivot]] = h[[pivot, m]], h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        for column, factor in zip(h[:, m + 1 :].T, factors):
            h[:, m] = (h[:, m] + column * factor) % p
    found = [np.ones(1, np.int64)]  # of the leading blocks, by falling power
    for m in range(n):
        next_ = np.zeros(m + 2, np.int64)
        next_[:-1] = found[m]
        next_[1:] = (next_[1:] - h[m, m] * found[m]) % p
        product = 1
        for i in range(m - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            next_[m + 1 - i :] = (next_[m + 1 - i :] - found[i] * (int(h[i, m]) * product % p)) % p
        found.append(next_)
    return found[n]


def _modulo(matrix: list[list[int]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_pydict({"p": [p], "residues": [polynomial_modulo(matrix, p).tolist()]})

    return work


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(z - matrix), exact, by falling power; matrix: symmetric, of integers."""
    size = len(matrix)
    if not size:
        return [1]
    # each coefficient is a sum of minors; Hadamard bounds a minor by the lengths of its rows, so all together by the product of 1 + length
    bound = math.prod(1 + math.isqrt(sum(v * v for v in row)) + 1 for row in matrix)
    chosen = primes(1 + (2 * bound).bit_length() // 30)
    rows = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(min(len(chosen), 4 * spark.sparkContext.defaultParallelism))
    known = {r["p"]: r["residues"] for r in rows.mapInArrow(_modulo(matrix), "p long, residues array<long>").collect()}  # a number a dimension and prime
    values, modulus = [0] * (size + 1), 1
    for p in chosen:
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, known[p])]
        modulus *= p
    return [v if 2 * v <= modulus else v - modulus for v in values]


def _variations(low: list[int]) -> int:
    signs = [v > 0 for v in low if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _shifted(low: list[int]) -> list[int]:
    """Coefficients of q(z + 1), by rising power as given."""
    out = list(low)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += out[j + 1]
    return out


def isolated_roots(polynomial: list[int], most: int) -> list[tuple[Fraction, Fraction, int]]:
    """(low, high, roots within): intervals apart from each other, from the largest root down to the most-th, of a polynomial whose roots are real and not negative.

    A root of zero is left out. An interval holds one root, or several that agree in APART bits of the largest possible.
    """
    low = polynomial[::-1]
    while len(low) > 1 and low[0] == 0:
        low = low[1:]
    degree = len(low) - 1
    if not degree:
        return []
    bits = max(1, abs(low[-2]).bit_length())  # roots are positive and add up to this coefficient
    top = [v << (bits * i) for i, v in enumerate(low)]  # q(2^bits z): roots in (0, 1]
    found: list[tuple[Fraction, Fraction, int]] = []
    stack = [(0, 0, top, _variations(top), _variations(_shifted(top)))]  # interval (at, at + 1] / 2^depth, and the roots above each end
    while stack and sum(f[2] for f in found) < most:
        at, depth, q, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if inside == 1 or (inside and depth >= APART):
            unit = Fraction(2) ** (bits - depth)
            found.append((at * unit, (at + 1) * unit, inside))
        elif inside:
            left = [v << (degree - i) for i, v in enumerate(q)]
            right = _shifted(left)
            middle = _variations(right)
            stack.append((2 * at, depth + 1, left, above_low, middle))
            stack.append((2 * at + 1, depth + 1, right, middle, above_high))  # the larger first
    return found


def refined_root(polynomial: list[int], low: Fraction, high: Fraction) -> Fraction:
    """The root in (low, high], to PRECISE bits; its sign must change there."""
    scale = max(low.denominator, high.denominator)
    shift = max(0, PRECISE - (max(1, int(high))).bit_length() - scale.bit_length() + 2)
    a, b = int(low * scale) << shift, int(high * scale) << shift  # in units of 1 / (scale << shift)
    unit = scale << shift

    def sign(at: int) -> int:
        value, power = 0, 1
        for c in polynomial:
            value, power = value * at + c * power, power * unit
        return (value > 0) - (value < 0)

    end = sign(b)
    while end and b - a > 1:
        middle = (a + b) // 2
        here = sign(middle)
        a, b = (a, middle) if here in (0, end) else (middle, b)
        end = here if b == middle else end
    return Fraction(b, unit) if not end else Fraction(a + b, 2 * unit)


def null_space(matrix: list[list[int]], root: Fraction, copies: int) -> list[list[float]]:
    """Unit vectors that (matrix - root) takes to zero, as many as copies, by inverse iteration in fixed point."""
    size, one = len(matrix), 1 << FIXED
    trace = sum(matrix[i][i] for i in range(size))
    a = [[v * one // trace for v in row] for row in matrix]
    shift = root.numerator * one // (root.denominator * trace)
    for i in range(size):
        a[i][i] -= shift
    order, least = list(range(size)), 1 << (FIXED // 8)
    for c in range(size):
        best = max(range(c, size), key=lambda r: abs(a[r][c]))
        a[c], a[best], order[c], order[best] = a[best], a[c], order[best], order[c]
        if abs(a[c][c]) < least:
            a[c][c] = least
        for r in range(c + 1, size):
            if a[r][c]:
                factor = a[r][c] = (a[r][c] << FIXED) // a[c][c]
                for j in range(c + 1, size):
                    a[r][j] -= factor * a[c][j] >> FIXED
    found: list[list[int]] = []
    for number in range(copies):
        v = [(pow(i + 2, 5 + number, 10_007) - 5_003) * one // 5_003 for i in range(size)]  # starts that differ, the same in every run
        for _ in range(3):
            y = [v[o] for o in order]
            for r in range(size):
                y[r] -= sum(a[r][j] * y[j] for j in range(r)) >> FIXED
            for r in range(size - 1, -1, -1):
                y[r] = ((y[r] << FIXED) - sum(a[r][j] * y[j] for j in range(r + 1, size))) // a[r][r]
            for _ in range(2):
                for f in found:
                    along = sum(p * q for p, q in zip(f, y)) >> FIXED
                    y = [q - (along * p >> FIXED) for p, q in zip(f, y)]
            length = math.isqrt(sum(q * q for q in y))
            v = [(q << FIXED) // length for q in y]
        found.append(v)
    largest = [max(range(size), key=lambda i: abs(v[i])) for v in found]
    return [[float(Fraction(q if v[at] > 0 else -q, one)) for q in v] for v, at in zip(found, largest)]


def _solved(matrix: list[list[int]], polynomial: list[int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, low, high, copies in zip(*(batch.column(c).to_pylist() for c in ("place", "low", "high", "copies"))):
                low, high = Fraction(low), Fraction(high)
                root = refined_root(polynomial, low, high) if copies == 1 else (low + high) / 2
                vectors = null_space(matrix, root, copies)
                yield pa.RecordBatch.from_pydict({"place": [place], "root": [str(root)], "vectors": [vectors]})

    return work


def principal_components(spark, scatter: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit vector) of an exact scatter matrix, the largest eigenvalue first, at most so many; those of zero are left out."""
    polynomial = characteristic_polynomial(spark, scatter)
    intervals = isolated_roots(polynomial, most)
    if not intervals:
        return []
    rows = [(i, str(low), str(high), copies) for i, (low, high, copies) in enumerate(intervals)]
    asked = spark.createDataFrame(rows, "place long, low string, high string, copies long").repartition(len(rows))
    solved = asked.mapInArrow(_solved(scatter, polynomial), "place long, root string, vectors array<array<double>>").collect()  # a row a root
    return [(Fraction(r["root"]), v) for r in sorted(solved, key=lambda r: r["place"]) for v in r["vectors"]][:most]


def _project(column: pa.Array, means: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = _rows(column, len(means))
    return rows, (rows - means) @ axes


def _gram(means: np.ndarray, axes: np.ndarray):
    """Sums of the whitened entries and of their products, one row a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = axes.shape[1]
        total, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                _, w = _project(batch.column("x"), means, axes)
                total, sums = total + w.T @ w, sums + w.sum(axis=0)
        at = np.indices((width, width)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(width, -1), at[0]])), pa.array(np.concatenate([np.arange(width), at[1]])), pa.array(np.concatenate([sums, total.ravel()]))],
            names=["i", "j", "part"],
        )

    return work


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exactly."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most * most * max(1, rows.shape[1]) < 2**63 else object
    off = rows.astype(kind) * n - np.array(sums, kind)
    return (off * off).sum(axis=1).tolist()


def _whitened(means: np.ndarray, axes: np.ndarray, n: int, sums: list[int], explained: list[float], error: float):
    width = axes.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                rows, w = _project(some.column("x"), means, axes)
                deviation = _deviations(rows, n, sums)
                fits = [d if d < 2**63 else None for d in deviation]
                each = np.repeat(np.arange(len(rows)), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(each), n)),
                        pa.array(fits, pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(len(each), error)),
                        pa.array([str(d) for d in deviation]).take(pa.array(each)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"],
                )

    return work


def whitened(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text of each row of vectors (vec_id, x: array of longs) and component.

    deviation is null where it is beyond 64 bits; deviation_text has all its digits. Entries may be shifted by a constant: all figures are of differences from the mean.
    """
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    given = vectors.where("x is not null").select("vec_id", "x")
    n, sums, products = exact_moments(given)
    scatter = [[n * v - a * b for v, b in zip(row, sums)] for row, a in zip(products, sums)]
    found = principal_components(spark, scatter, most)
    if not found:
        return spark.createDataFrame([], schema)
    means = np.array([float(Fraction(s, n)) for s in sums])
    axes = np.array([v for _, v in found]).T / np.array([math.sqrt(Fraction(root, n * n)) for root, _ in found])
    parts = given.select("x").mapInArrow(_gram(means, axes), "i long, j long, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()
    gram = {(r["i"], r["j"]): r["part"] / n for r in parts}  # a row for each pair of components
    width = axes.shape[1]
    error = max(abs(gram[i, j] - gram[-1, i] * gram[-1, j] - (i == j)) for i in range(width) for j in range(width))
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    explained = [float(root / trace) for root, _ in found]
    return given.mapInArrow(_whitened(means, axes, n, sums, explained, error), schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    # the constant 1000000 that the entries are shifted by leaves every figure as it is
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("x")))
