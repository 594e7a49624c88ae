"""MinHash near-duplicate groups by an LSH forest.

Each document is a set of five-word shingles (64-bit hashes). Documents with equal sets are one class and only its smallest id goes on. Each class
has HASHES minimum hashes. A tree of the forest orders all classes by their minimum hashes, rotated to another start for each tree,
and the candidates of a class are its NEIGHBOURS predecessors in each order that share LEAST_PREFIX hashes with it or more.
In a region (classes that share the least prefix) that goes on for more than NEIGHBOURS rows, only the DENSE_NEIGHBOURS nearest, which share the longest
prefixes, are taken: a sparse region is searched down to the least prefix and a dense one as deep as its nearest neighbours, so the depth adapts,
work is linear in the rows, and an order is dealt to tasks by range, wherever a region's bounds lie (a task gives its last rows to the next).

Candidates whose sizes or sketches (two bits of each minimum hash) rule the similarity out are dropped at once. The rest is confirmed on the full sets, made
anew from the whole texts, in rounds: first the likeliest candidate of each class, then each group's likeliest link to other groups, then
all candidates that still lie in different groups; a link inside a group can't change the groups, so none is lost by skipping it.
Last come the regions, of all trees, with more rows than the neighbours reach and more than one group: every pair there that lies in different groups
is compared, in blocks of bounded size, so whatever shares LEAST_PREFIX hashes in some tree has been compared or lies in one group.

Defined cases: a null or empty text has an empty set, is linked with nothing and stays; fewer than five words count as one shingle; null ids are
groups of their own that stay, with component_id null; rows that repeat an id are one node with the links of all their texts; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, release, table, temporaries, written
from .graph import components

SHINGLE = 5
HASHES = 128
TREES = 16
PREFIX = 16  # minimum hashes in a tree's sort key, two bytes each
LEAST_PREFIX = 4  # see least_prefix()
MISS = 2e-5
NEIGHBOURS = 24
DENSE_NEIGHBOURS = 10
BLOCK_ROWS = 2048  # of a large region's rows, and of the shingles of their sets, that one side of a comparison of blocks has on average
BLOCK_SHINGLES = 2_000_000
SIGMAS = 4.5  # sketches that differ by so many standard deviations more than they should at the least similarity rule a pair out

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers of it have inverses modulo 2 ** 64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of a 64-bit finaliser
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []  # of _STEP, and of its inverse modulo 2 ** 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse from 0, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        bases = (_STEP, np.uint64(pow(int(_STEP), -1, 2**64)))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in bases]
    return _powers


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased, words end at ASCII white space."""
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_IS_SPACE[raw]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    word = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    width = min(SHINGLE, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = total * _STEP + word[i : n - width + 1 + i]
    if n < SHINGLE:
        total = total + np.uint64(n)
    return np.unique(_mixed(total))


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def least_prefix(percent: int) -> int:
    """How many hashes candidates share at least: LEAST_PREFIX, or fewer if a pair at the least similarity would miss that in all trees with a chance above MISS."""
    return next((p for p in range(LEAST_PREFIX, 1, -1) if (1 - (percent / 100) ** p) ** TREES <= MISS), 1)


def _pack(values: np.ndarray) -> np.ndarray:
    return (values.reshape(-1, 4).astype(np.uint8) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)


def most_different(percent: int) -> float:
    """In how many of the HASHES places sketches may differ."""
    p = (1 - percent / 100) * 3 / 4
    return HASHES * p + SIGMAS * (HASHES * p * (1 - p)) ** 0.5


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Two bytes of each minimum hash, and a sketch of two bits of each."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(x), 512):  # a block that stays in the cache
        np.minimum(least, (x[s : s + 512, None] * _A + _B).min(0), out=least)
    values = _mixed(least.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    return (values >> np.uint64(48)).astype(">u2"), _pack(values & np.uint64(3)).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n (shingles), digest (of the set), mins, sketch."""
    for batch in batches:
        out: dict[str, list] = {"n": [], "digest": [], "mins": [], "sketch": []}
        for text in batch.column("text"):
            found = shingles(text.as_py())
            mins, sketch = signature(found)
            out["n"].append(len(found))
            out["digest"].append(np.array([np.add.reduce(found), np.bitwise_xor.reduce(_mixed(found ^ _STEP)) if len(found) else 0], np.uint64).tobytes())
            out["mins"].append(mins.tobytes())
            out["sketch"].append(sketch)
        kinds = {"n": pa.int64(), "digest": pa.binary(), "mins": pa.binary(), "sketch": pa.binary()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: tree, key (the rotated signature's start), id, n, sketch."""
    for batch in batches:
        n = batch.num_rows
        mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), "V2").reshape(n, HASHES)
        for t in range(TREES):
            at = (np.arange(PREFIX) + t * (HASHES // TREES)) % HASHES
            keys = [row.tobytes() for row in np.ascontiguousarray(mins[:, at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(keys, pa.binary()), batch.column("doc_id"), batch.column("n"), batch.column("sketch")], names=["tree", "key", "id", "n", "sketch"])


class _Order:
    """Rows of an order as arrays."""

    def __init__(self, tree, key, ids, n, sketch):
        self.columns = (tree, key, ids, n, sketch)

    @classmethod
    def of(cls, batch) -> _Order:
        size = batch.num_rows
        fixed = lambda name, kind, w: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(size, w)
        return cls(batch.column("tree").to_numpy(), fixed("key", ">u2", PREFIX), batch.column("id").to_numpy(), batch.column("n").to_numpy(), fixed("sketch", np.uint8, HASHES // 4))

    def __len__(self) -> int:
        return len(self.columns[0])

    def part(self, start: int, stop: int) -> _Order:
        return _Order(*(c[start:stop] for c in self.columns))

    def plus(self, other: _Order) -> _Order:
        return _Order(*(np.concatenate(x) for x in zip(self.columns, other.columns)))

    def pairs(self, fresh: int, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates (a < b, bits that differ) of the rows from fresh on with up to NEIGHBOURS rows before each."""
        tree, key, ids, n, sketch = self.columns
        most, least = most_different(percent), least_prefix(percent)
        far = np.arange(NEIGHBOURS, len(self))
        dense = np.zeros(len(self), bool)  # has NEIGHBOURS rows of its region before it
        dense[far] = (tree[far] == tree[far - NEIGHBOURS]) & (key[far, :least] == key[far - NEIGHBOURS, :least]).all(1)
        for lag in range(1, NEIGHBOURS + 1):
            low = max(fresh, lag)
            if low >= len(self):
                return
            here = np.arange(low, len(self))
            here = here if lag <= DENSE_NEIGHBOURS else here[~dense[here]]
            there = here - lag
            keep = (tree[here] == tree[there]) & (key[here, :least] == key[there, :least]).all(1)
            here, there = here[keep], there[keep]
            keep = (np.minimum(n[here], n[there]) * 100 >= percent * np.maximum(n[here], n[there])) & (ids[here] != ids[there])
            here, there = here[keep], there[keep]
            bits = sketch[here] ^ sketch[there]
            bits = np.bitwise_count((bits | bits >> 1) & 0x55).sum(1)
            keep = bits <= most
            a, b = ids[here[keep]], ids[there[keep]]
            yield np.minimum(a, b), np.maximum(a, b), bits[keep].astype(np.int32)


_EDGE_FIELDS = "part long, place long, tree int, key binary, id long, n long, sketch binary"


def _edge_rows(part: int, place: int, rows: _Order) -> dict:
    tree, key, ids, n, sketch = rows.columns
    size = len(rows)
    return {
        "a": [None] * size, "b": [None] * size, "bits": [None] * size, "part": [part] * size, "place": list(range(place, place + size)), "tree": tree.tolist(),
        "key": [k.astype(">u2").tobytes() for k in key], "id": ids.tolist(), "n": n.tolist(), "sketch": [s.tobytes() for s in sketch],
    }


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _pair_rows(found) -> Iterator[pa.RecordBatch]:
    for a, b, bits in found:
        if len(a):
            empty = [pa.nulls(len(a), t) for t in _OUT.types[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits), *empty], schema=_OUT)


def _neighbours(percent: int):
    """Candidates within each partition of an order, and its first and last rows (place from 0, and from the end below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _Order.of(batch)
            first = fresh.part(0, 0) if first is None else first
            if len(first) < NEIGHBOURS:
                first = first.plus(fresh.part(0, NEIGHBOURS - len(first)))
            start = len(kept) if kept else 0
            rows = kept.plus(fresh) if kept else fresh
            yield from _pair_rows(rows.pairs(start, percent))
            kept = rows.part(max(0, len(rows) - NEIGHBOURS), len(rows))
        if kept is not None:
            yield pa.RecordBatch.from_pydict(_edge_rows(part, 0, first), schema=_OUT)
            yield pa.RecordBatch.from_pydict(_edge_rows(part, -len(kept), kept), schema=_OUT)

    return run


def _across(percent: int):
    """Candidates between the last rows of some partitions and the first ones of the one that follows them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("following", "ascending"), ("part", "ascending"), ("place", "ascending")]).combine_chunks()
        n_before = pc.sum(pc.invert(rows["following"]).cast(pa.int64())).as_py() or 0
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in rows.to_batches():
            out = [np.concatenate(x) for x in zip(out, *_Order.of(batch).pairs(n_before, percent))]
        return pa.table({"a": out[0], "b": out[1], "bits": out[2]})

    return run


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b, bits: pairs of ids (a < b) that stand near each other in some tree; distinct and written."""
    rows = classes.select("doc_id", "n", "mins", "sketch").mapInArrow(_tree_rows, "tree int, key binary, id long, n long, sketch binary")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = written(ordered.mapInArrow(_neighbours(percent), "a long, b long, bits int, " + _EDGE_FIELDS), "found")
    edges = found.where("part is not null")
    # partitions that have rows, in order, a row each: the last rows of each meet the first ones of those that begin less than NEIGHBOURS rows on
    used = edges.where("place < 0").groupBy("part").agg(F.count("*").alias("rows")).withColumn("rank", F.row_number().over(Window.orderBy("part")))
    used = written(used.withColumn("upto", F.sum("rows").over(Window.orderBy("part"))), "used")
    ahead = used.select("part", "upto", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + NEIGHBOURS)).alias("rank"))
    later = used.select("rank", F.col("part").alias("meets"), (F.col("upto") - F.col("rows")).alias("from"))
    meets = ahead.join(later, "rank").where(F.col("from") - F.col("upto") < NEIGHBOURS).select("part", "meets")
    seam = edges.where("place < 0").join(meets, "part").withColumn("following", F.lit(False))
    seam = seam.unionByName(edges.where("place >= 0").join(meets.select(F.col("meets").alias("part")).distinct(), "part").withColumn("meets", F.col("part")).withColumn("following", F.lit(True)))
    seam = seam.select("meets", "following", "part", "place", "tree", "key", "id", "n", "sketch")
    met = seam.groupBy("meets").applyInArrow(_across(percent), "a long, b long, bits int")
    pairs = written(found.where("a is not null").select("a", "b", "bits").unionByName(met).groupBy("a", "b").agg(F.min("bits").alias("bits")), "pairs")
    drop_written(found)
    return pairs


def _confirm(percent: int):
    """a, b, a_text, b_text -> a, b of the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, mine = [], None, None
            for text, other in zip(batch.column("a_text"), batch.column("b_text")):
                if (text := text.as_py()) != last or mine is None:
                    last, mine = text, shingles(text)
                theirs = shingles(other.as_py())
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(theirs) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: id, text."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(percent), "a long, b long")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """The likeliest pair of each group on either side. pairs: a, b, bits, ca, cb (their groups)."""
    best = F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p")
    sides = [pairs.groupBy(c).agg(best) for c in ("ca", "cb")]
    return sides[0].select("p.*").union(sides[1].select("p.*")).distinct()


def _grouped(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """pairs between different groups, with them as ca and cb; a node that no group has is its own."""
    if groups is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    for side in "ab":
        pairs = pairs.join(groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.where("ca <> cb")


def _starts(mins: np.ndarray, least: int) -> np.ndarray:
    """The first hashes, as many as least says, of each tree's keys as one number. mins: a row of HASHES a class."""
    out = np.zeros((len(mins), TREES), np.uint64)
    for i in range(least):
        out = out << np.uint64(16) | mins[:, (np.arange(TREES) * (HASHES // TREES) + i) % HASHES].astype(np.uint64)
    return out


def _region_rows(percent: int):
    """A row for each class and tree: tree, region, id, n, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            regions = _starts(np.frombuffer(b"".join(batch.column("mins").to_pylist()), ">u2").reshape(size, HASHES), least_prefix(percent)).view(np.int64)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, t, np.int32)), pa.array(np.ascontiguousarray(regions[:, t])), *(batch.column(c) for c in ("doc_id", "n", "component"))], names=["tree", "region", "id", "n", "component"])

    return run


def _linked(percent: int):
    """Links (a, b) between different groups of a block, enough to join all that such links join; a pair that shares the start of an earlier tree is left to that one."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [shingles(t.as_py()) for t in rows["text"]]
        tree, sides = rows["tree"][0].as_py(), rows["side"].to_numpy()
        order = np.array([i for i in np.argsort(sides, kind="stable") if len(sets[i])], int)
        sets, sides = [sets[i] for i in order], sides[order]
        ids, group = rows["id"].to_numpy()[order], rows["component"].to_numpy()[order].copy()
        n, out = np.array([len(x) for x in sets], int), []
        if len(sets):
            signed = [signature(x) for x in sets]
            starts = _starts(np.array([m for m, _ in signed]), least_prefix(percent))[:, :tree]
            sketch = np.frombuffer(b"".join(k for _, k in signed), np.uint64).reshape(len(sets), -1)
            numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n)[:-1])
            inside = np.zeros(n.sum(), bool)
            second = int((sides == 0).sum()) if sides[-1] else None  # where the other side begins
        for i in range(len(sets) if not len(sets) or second is None else second):
            there = np.arange(i + 1 if second is None else second, len(sets))
            there = there[(group[there] != group[i]) & (np.minimum(n[there], n[i]) * 100 >= percent * np.maximum(n[there], n[i]))]
            bits = sketch[there] ^ sketch[i]
            there = there[np.bitwise_count((bits | bits >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1) <= most]
            there = there[~(starts[there] == starts[i]).any(1)]
            if not len(there):
                continue
            inside[numbers[i]] = True
            both = np.add.reduceat(inside[np.concatenate([numbers[j] for j in there])].astype(np.int64), np.cumsum(n[there]) - n[there])
            inside[numbers[i]] = False
            there = there[100 * both >= percent * (n[i] + n[there] - both)]
            joined, at = np.unique(group[there], return_index=True)
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in there[at]]
            if len(joined):
                group[np.isin(group, joined)] = group[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    most = most_different(percent)
    return run


def dense_links(classes: DataFrame, rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: links between different groups within the regions that go on for more than NEIGHBOURS rows; written."""
    placed = classes.select("doc_id", "n", "mins").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = placed.select("doc_id", "n", "mins", "component").mapInArrow(_region_rows(percent), "tree int, region long, id long, n long, component long")
    sizes = placed.groupBy("tree", "region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = sizes.where((F.col("size") > NEIGHBOURS) & (F.col("low") != F.col("high"))).select("tree", "region", parts.alias("parts"))
    dense = written(placed.join(mixed, ["tree", "region"]).select("tree", "region", "id", "component", "parts").distinct(), "dense")
    texts = rows.join(dense.select("id").distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    # each part of a region meets itself and each other part
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = dense.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("tree", "region", "id", "component", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("last"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    found = met.join(texts, "id").groupBy("tree", "region", "first", "last").applyInArrow(_linked(percent), "a long, b long")
    links = written(found.distinct(), "links")
    drop_written(dense)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; links need 100 * intersection >= percent * union."""
    with temporaries(docs.sparkSession):
        return written(_near_duplicates(docs, percent), "near", keep=True)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    rows = docs.select("doc_id", "text")
    signed = rows.mapInArrow(_sign, "doc_id long, n long, digest binary, mins binary, sketch binary")
    signed = written(signed, "signed")
    known = signed.where("doc_id is not null")
    # equal sets are one class, known by its smallest id
    classes = written(known.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "classes")
    pairs = candidates(classes, percent)
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # hashed without a sort of the texts; the nodes grow with the input, so they are never broadcast
    texts = rows.join(nodes.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    texts = written(texts, "texts")
    links, groups, left = None, None, pairs
    for last in (False, False, True):
        open_pairs = written(_grouped(left.select("a", "b", "bits"), groups), "open")
        chosen = open_pairs.select("a", "b") if last else _likeliest(open_pairs)
        chosen = written(chosen, "chosen")
        good = written(confirmed(chosen, texts, percent), "good")
        links = good if links is None else written(links.unionByName(good), "links")
        groups = components(links)
        left = open_pairs.join(chosen, ["a", "b"], "left_anti")
    drop_written(texts)
    groups = components(links.unionByName(dense_links(classes, rows, groups, percent)))
    same = known.join(classes.select("digest", "n", F.col("doc_id").alias("class_id")), ["digest", "n"], "left").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = same.select("doc_id", "n", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    placed = placed.unionByName(signed.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node
)
SELECT doc_id, n AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""
