"""Fuzzy line dedup: of each group of like lines in the corpus, one occurrence stays.

Lines are normalised (lower case, single spaces). Two lines are linked if they are equal, or if they meet in a bucket and their edit similarity,
1 - distance / longer length, is at least `similarity`; nothing else decides, and no rule depends on the size of the corpus. Of each connected group the
first occurrence stays, by document id (null first) and line number.

Buckets are of three kinds; words are what stands between spaces and punctuation, or single characters of scripts that don't separate words:

SimHash blocks (block_keys): equal lines are collapsed first. The distinct words of a line that have LONG_WORD characters or more, and the pairs of characters
of scripts without spaces, are dealt to blocks by hash, and each block has a SimHash of its own words alone (40 bits, the majority of the words' bits).
So a changed word touches two blocks at most, the others keep their SimHash, and by the pigeonhole principle lines that differ in w words agree in all but
2 w blocks. Lines are joined on each block, or on each two blocks if they are short (LEVELS); lines of a length where the like may belong to the next level
are joined as both. A block has BLOCK_WORDS words or more.

Lines of few words (block_keys with few) can't fill blocks. They are joined on the words that stay when any one or none is left out (ONE_OUT words or fewer) or any
two (TWO_OUT or fewer), and at least half of the words' characters stay: all lines that differ in no more than that meet, whatever their words' lengths.

Lines of TINY characters or fewer (tiny_keys) are joined on what stays when as many characters are left out as edits are allowed: all pairs of
such lines that are alike meet, without exception.

In each bucket (lines that share a block) every line is compared with one representative, and the groups of these links are found. Then the lines of a bucket
that lie in different groups are compared too (rest_of_buckets): their leaders first, which may be linked themselves, and pairs of lines only where the leaders'
distance leaves it open. So no link between groups is lost, while a bucket of like lines costs no more than its size.
Everything is Spark expressions, joins and aggregations; line texts are only read again for pairs.

Defined cases: lines without a word are never dropped; a null text stays null; rows equal in id and text count as one document and are treated
alike; other columns are carried, but for those named like an output column (n_lines, n_dropped), which it replaces; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, drop_written, fenced, key_filter, maybe_in, release, spare, table, temporaries, written
from .graph import components

LONG_WORD = 4
BLOCK_WORDS = 3  # distinct long words that a block has at least
TWO_OUT, ONE_OUT = 8, 16
TINY = 14
#: (characters that a line has less than, blocks, blocks that are joined on together)
LEVELS = ((100, 6, 2), (250, 6, 1), (float("inf"), 12, 1))
SHARES = lcm(*[blocks for _, blocks, _ in LEVELS])
SUMS, FIELDS, FIELD = 8, 5, 12  # a SimHash's counters: sums, counters in each, bits of a counter
PIECES = (128, 512)  # characters
ONES = sum(1 << FIELD * i for i in range(FIELDS))
#: Code points of scripts that don't separate words, and of punctuation and space, as parts of regular expression classes.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
MARKS = r"\x00-/:-@\[-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\xD7\xF7\u2000-\u206F\u3000-\u303F"
WORD = rf"[a-z0-9]++[^{MARKS}{UNSPACED}]*+|[^{MARKS}{UNSPACED}]++|[{UNSPACED}]"  # the first form is one of the second, found faster


def occurrences(docs: DataFrame) -> DataFrame:
    """k_id, k_text, line_no, key, norm of every line with a word."""
    lines = docs.select(*doc_key(), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    unlike = F.lit(False)
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        unlike = unlike | F.contains("line", F.lit(space))
    norm = F.trim(F.lower(F.when(unlike, F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")).otherwise(F.col("line"))))
    lines = fenced(lines, F.col("k_id"), F.col("k_text"), F.col("line_no"), norm.alias("norm")).where("norm <> ''")
    return lines.select("k_id", "k_text", "line_no", F.xxhash64("norm").alias("key"), "norm")


def _slot_table() -> list[list[int]]:
    """By levels that a line is in (a bit each) and a word's hash modulo SHARES: numbers of the blocks, or choices of them, that the word counts in."""
    out = []
    for levels in range(1 << len(LEVELS)):
        for share in range(SHARES):
            first, slots = 0, []
            for i, (_, blocks, together) in enumerate(LEVELS):
                choices = list(combinations(range(blocks), together))
                slots += [first + c for c, choice in enumerate(choices) if levels >> i & 1 and share % blocks in choice]
                first += len(choices)
            out.append(slots)
    return out


def _levels(similarity: float) -> Column:
    """Of len (a line's length): the levels that the line is in, a bit each."""
    least, out = 0, F.lit(0)
    for i, (below, _, _) in enumerate(LEVELS):
        # lines of the next level may be like lines of this one that have as little as their length times similarity
        within = (F.col("len") >= least) & (F.lit(True) if below == float("inf") else F.col("len") * similarity < below)
        out, least = out + F.when(within, 1 << i).otherwise(0), below
    return out


def _simhash() -> Column:
    """Of n and the sums s0, s1, ...: bits that more than half of n words have.

    A counter is doubled and raised so that its top bit is set just if twice the count is above n. (Beyond 2,048 words to a block counters run
    into each other, which gives other bits, but equal ones for equal words.)
    """
    lift = F.lit(ONES) * F.greatest((1 << FIELD - 1) - 1 - F.col("n"), F.lit(0))
    doubled = [F.shiftleft(F.col(f"s{s}").bitwiseAND((1 << FIELD * FIELDS) - 1), 1) for s in range(SUMS)]
    tops = [F.shiftrightunsigned(d + lift, FIELD - 1).bitwiseAND(F.lit(ONES)) for d in doubled]
    out = tops[0]
    for s in range(1, SUMS):
        out = out.bitwiseOR(F.shiftleft(tops[s], s))
    return out


def _any_two(n: Column, made) -> Column:
    """made(i, j) for all i < j below n + 2, where n and n + 1 stand for none."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.sequence(i + 1, n + 1), lambda j: made(i, j))))


def _few_word_buckets() -> Column:
    """Of w (hash h and length n of each of size words, and twice none), all (their exclusive or) and n (their length): hashes of what stays of few words."""

    def without(i, j):
        x, y = F.get("w", i), F.get("w", j)
        return F.when(2 * (x["n"] + y["n"]) <= F.col("n"), F.xxhash64(F.lit("few words"), F.col("all").bitwiseXOR(x["h"]).bitwiseXOR(y["h"])))

    one = F.transform(F.sequence(F.lit(0), "size"), lambda i: without(i, F.col("size")))
    some = F.when(F.col("size") <= TWO_OUT, _any_two(F.col("size"), without)).otherwise(one)
    return F.when(F.col("w").isNotNull(), F.array_distinct(F.array_compact(some))).otherwise(F.array().cast("array<long>"))


def _by_key(df: DataFrame, *columns: Column) -> DataFrame:
    """key and the columns, made once a row; the key stays the column by which the rows are distributed."""
    return df.select("key", F.inline(F.array(F.struct(*columns))))


def block_keys(lines: DataFrame, words: int, similarity: float, few: bool = False) -> DataFrame:
    """key, norm, distributed by key -> key, len, bucket: a row for each block, or pair of blocks, with enough words.

    The words of a line stay where the line is, so counting them by key and block needs no further shuffle. With few also, of lines of few words, those words
    that stay without any two (TWO_OUT), one (ONE_OUT) or none, as an order-free hash: these buckets pass through the same count, each by itself, so that lines
    are gathered and their words looked for once.
    """
    lines = _by_key(lines, F.length("norm").alias("len"), F.col("norm"), F.regexp_extract_all("norm", F.lit(WORD), F.lit(0)).alias("w"))
    pairs = F.regexp_extract_all("norm", F.lit(f"(?=([{UNSPACED}]{{2}}))"), F.lit(1))
    words_of = F.when(F.col("norm").rlike(f"[{UNSPACED}]"), F.concat("w", F.transform(pairs, lambda p: F.concat(p, p)))).otherwise(F.col("w"))  # doubled, they are long
    hashes = F.array_distinct(F.transform(F.filter(words_of, lambda x: F.length(x) >= LONG_WORD), lambda x: F.xxhash64(x)))
    none = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("n"))
    hashed = F.concat(F.transform("w", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))), F.array(none, none))
    few_words = F.size("w").between(1, ONE_OUT) & F.lit(few)
    lines = _by_key(lines, F.col("len"), hashes.alias("hashes"), F.size("w").alias("size"), F.when(few_words, hashed).alias("w"))
    xor, total = F.aggregate("w", none["h"], lambda t, x: t.bitwiseXOR(x["h"])), F.aggregate("w", none["n"], lambda t, x: t + x["n"])
    lines = _by_key(lines, F.col("len"), F.col("hashes"), F.col("size"), F.col("w"), xor.alias("all"), total.alias("n"))
    enough = F.when(F.size("hashes") >= words, F.col("hashes")).otherwise(F.array().cast("array<long>"))
    told = lambda made: lambda h: F.struct(h.alias("h"), F.lit(made).alias("made"))
    either = F.concat(F.transform(enough, told(False)), F.transform(_few_word_buckets(), told(True)))
    each = lines.select("key", "len", _levels(similarity).alias("levels"), F.inline(either))
    table = F.array(*[F.array(*map(F.lit, slots)).cast("array<int>") for slots in _slot_table()])
    slots = F.get(table, (F.col("levels") * SHARES + F.pmod("h", F.lit(SHARES))).cast("int"))
    own = F.when(F.col("made"), F.col("h")).otherwise(F.lit(0).cast("long"))
    each = each.select("key", "len", "h", own.alias("own"), F.explode(F.when(F.col("made"), F.array(F.lit(-1))).otherwise(slots)).alias("slot"))
    counts = [F.try_sum(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(ONES))).alias(f"s{s}") for s in range(SUMS)]
    blocks = each.groupBy("key", "len", "slot", "own").agg(F.count("*").alias("n"), *counts).where((F.col("n") >= words) | (F.col("slot") < 0))
    return blocks.select("key", "len", F.when(F.col("slot") < 0, F.col("own")).otherwise(F.xxhash64("slot", "n", _simhash())).alias("bucket"))


def tiny_keys(lines: DataFrame, similarity: float) -> DataFrame:
    """key, norm -> key, len, bucket: of lines of TINY characters or fewer, what stays without as many characters as a line like them may have edits."""
    tiny = lines.select("key", "norm", F.length("norm").alias("len")).where(F.col("len") <= TINY)
    longest = F.least(F.floor(F.col("len") / similarity + 1e-9), F.lit(TINY))
    tiny = tiny.withColumn("edits", F.floor(longest * (1 - similarity) + 1e-9)).where("edits > 0")
    tiny = tiny.withColumn("left", F.array("norm"))
    one_less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    for k in range(int(TINY * (1 - similarity) + 1e-9)):
        more = F.when(F.col("edits") > k, F.flatten(F.transform("left", lambda x: F.when(F.length(x) > 0, one_less(x)).otherwise(F.array(x))))).otherwise(F.array().cast("array<string>"))
        tiny = tiny.withColumn("left", F.array_distinct(F.concat("left", more)))
    return tiny.select("key", "len", F.explode(F.transform("left", lambda x: F.xxhash64(F.lit("tiny"), x))).alias("bucket"))


def _shared(x: Column, y: Column, last: bool) -> Column:
    """How many characters x and y, different texts, have in common at their beginning, or at their end: by halving steps, so in few comparisons."""
    part = (lambda t, n: F.substring(t, -n, n)) if last else (lambda t, n: F.substring(t, F.lit(1), n))
    bits = F.ceil(F.log2(F.least(F.length(x), F.length(y)) + 1)).cast("int")
    steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    fits = lambda n: (n <= F.least(F.length(x), F.length(y))) & (part(x, n) == part(y, n))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def _distance(x: Column, y: Column, most: Column | None = None) -> Column:
    return F.call_function("levenshtein", x, y, *([] if most is None else [most]))


def _beyond(x: Column, y: Column, most: Column) -> Column:
    """Whether a part of x and y shows that their distance is above most.

    Ends of the same length, taken off both, never raise a distance. Unlike texts differ in more than half of their characters, so a window with a few more than
    twice as many as most tells them apart in a fraction of the time.
    """
    off = F.least(F.length(x), F.length(y)) - (2 * most + 20)
    return (off > 0) & (_distance(F.substring(x, F.lit(1), F.length(x) - off), F.substring(y, F.lit(1), F.length(y) - off), most) < 0)


def _by_pieces(x: Column, y: Column, size: int) -> Column:
    """The distances of pieces of x of that size and pieces of y in proportion, summed: no less than the distance of x and y, in time that grows with their length."""
    n = F.ceil(F.length(x) / size).cast("int")
    at = lambda t, i: F.floor(F.length(t) * i / n).cast("int")
    piece = lambda t, i: F.substring(t, at(t, i) + 1, at(t, i + 1) - at(t, i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + _distance(piece(x, i), piece(y, i)))


def measured_pairs(both: DataFrame, similarity: float) -> DataFrame:
    """The rows of both (a_norm, b_norm, different, and others) whose lines have the edit similarity, and far: their distance, or a number above it that is allowed too.

    What both begin and end with is left out first. Lines with as many words are alike if the words that differ, replaced whole, are few enough, and others if
    their pieces are. Lines that this leaves open are unlike if a window shows it; else their distance is measured as far as it is allowed to go.
    """
    n = {"x": F.length("a_norm"), "y": F.length("b_norm")}
    allowed = F.floor(F.greatest(n["x"], n["y"]) * (1 - similarity) + 1e-9).cast("int")
    df = both.where(F.abs(n["x"] - n["y"]) <= allowed)
    carry = [F.col(c) for c in both.columns]
    df = fenced(df, *carry, allowed.alias("_allowed"), _shared(F.col("a_norm"), F.col("b_norm"), False).alias("_first"))
    rest = [F.substring(c, F.col("_first") + 1, F.length(c)).alias(name) for c, name in (("a_norm", "_x"), ("b_norm", "_y"))]
    df = fenced(df, *carry, F.col("_allowed"), *rest)
    df = fenced(df, *carry, F.col("_allowed"), F.col("_x"), F.col("_y"), _shared(F.col("_x"), F.col("_y"), True).alias("_last"))
    df = fenced(df, *carry, F.col("_allowed"), *[F.substring(c, F.lit(1), F.length(c) - F.col("_last")).alias(c) for c in ("_x", "_y")])
    x, y, most = F.col("_x"), F.col("_y"), F.col("_allowed")
    longer = F.greatest(F.length(x), F.length(y))
    costs = F.zip_with(F.split(x, " "), F.split(y, " "), lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(F.coalesce(F.greatest(F.length(p), F.length(q)), F.lit(1 << 30))))
    as_many = F.length(F.replace(x, F.lit(" "), F.lit(""))) - F.length(x) == F.length(F.replace(y, F.lit(" "), F.lit(""))) - F.length(y)
    replaced = F.when(as_many, F.aggregate(costs, F.lit(0).cast("long"), lambda total, c: total + c)).otherwise(F.lit(1 << 40))
    tries = [(F.lit(True), lambda: replaced), *[((longer > 2 * size), lambda size=size: _by_pieces(x, y, size)) for size in PIECES]]
    far = F.when(longer <= most, longer.cast("long"))
    df = fenced(df, *carry, most, x, y, far.alias("far"))
    for applies, bound in tries:
        made = F.when(F.col("far").isNull() & applies, bound().cast("long"))
        df = fenced(df, *carry, most, x, y, F.col("far").alias("_far"), made.alias("_made"))
        df = df.select(*carry, most, x, y, F.coalesce("_far", F.when(F.col("_made") <= most, F.col("_made"))).alias("far"))
    last = F.when(F.col("far").isNotNull(), F.col("far")).when(_beyond(x, y, most), F.lit(-1)).otherwise(_distance(x, y, most))
    return fenced(df, *carry, last.cast("int").alias("far")).where("far >= 0")


def similar_pairs(both: DataFrame, similarity: float) -> DataFrame:
    """The rows of both (a_norm, b_norm and others) whose lines have the edit similarity."""
    return measured_pairs(both, similarity).select(*both.columns)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("norm").alias("a_norm")), "a")
    return both.join(texts.select(F.col("key").alias("b"), F.col("norm").alias("b_norm")), "b")


def _verified(found: DataFrame, pairs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """a, b, far of the pairs whose lines have the edit similarity, and key, norm of all pairs' lines; written."""
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    texts = maybe_in(found.select("key", "norm"), "key", key_filter(keys, "key"))
    # an inner join: Spark would put a semi join below the bitmap, and so shuffle every line
    texts = written(texts.groupBy("key").agg(F.first("norm").alias("norm")).join(keys, "key"), "texts")
    links = written(measured_pairs(_with_texts(pairs, texts), similarity).select("a", "b", "far"), "links")
    drop_written(keys)
    release(found.sparkSession)
    return links, texts


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component) when links (a, b) between lines of different groups join these."""
    for side in "ab":
        links = links.join(groups.select(F.col("node").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    joined = components(links)
    told = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(told.unionByName(joined.join(told.select("node"), "node", "left_anti")), "regrouped")


def _placed(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """lines (key and others) with the component of each: itself, where groups don't list it."""
    return lines.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def _allowed(similarity: float, *lens: str) -> Column:
    return F.floor(F.greatest(*lens) * (1 - similarity) + 1e-9).cast("int")


def rest_of_buckets(met: DataFrame, links: DataFrame, groups: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """groups with the links between lines of a bucket that the links so far leave in different groups.

    Each line stands near a leader, the first line that it is linked to, or itself. By the triangle inequality two lines differ in no less than their leaders do,
    less what each is away from its leader; so where leaders differ by far no pair of their lines is looked at. Like leaders join their groups at once. Only the
    lines of leaders in between are compared, pair by pair, as far as their own distances leave it open.
    """
    leaders = links.groupBy(F.col("b").alias("key")).agg(F.min(F.struct("a", "far")).alias("l")).select("key", F.col("l.a").alias("leader"), F.col("l.far").alias("far"))
    placed = _placed(met, groups)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2")
    apart = placed.join(mixed.select("bucket"), "bucket", "left_semi").select("bucket", "key", "len", "component").join(leaders, "key", "left")
    apart = apart.select("bucket", "key", "len", "component", F.coalesce("leader", "key").alias("leader"), F.coalesce("far", F.lit(0)).alias("far"))
    apart = written(apart, "apart")
    led = _with_texts(apart.where("far > 0").select(F.col("leader").alias("a"), F.col("key").alias("b"), "far").distinct(), texts)
    exact = F.when(F.length("b_norm") <= 2000, _distance(F.col("a_norm"), F.col("b_norm"), F.col("far"))).otherwise(F.col("far"))
    exact = written(led.select(F.col("b").alias("key"), exact.alias("exact")), "exact")
    apart = apart.join(exact, "key", "left").select("bucket", "key", "len", "component", "leader", F.coalesce("exact", "far").alias("far"))
    parts = apart.groupBy("bucket", "leader").agg(F.first("component").alias("component"), F.max("far").alias("far"), F.min("len").alias("least"), F.max("len").alias("most"))
    a, b = (parts.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in parts.columns[1:]]) for side in "ab")
    near = (F.col("a_component") < F.col("b_component")) & (F.col("a_most") >= F.col("b_least") * similarity) & (F.col("b_most") >= F.col("a_least") * similarity)
    limit = _allowed(similarity, "a_most", "b_most") + F.col("a_far") + F.col("b_far")
    two = written(a.join(b, "bucket").where(near).select("bucket", F.col("a_leader").alias("a"), F.col("b_leader").alias("b"), limit.alias("limit")), "leaders")
    both = _with_texts(two.groupBy("a", "b").agg(F.max("limit").alias("limit")), texts)
    x, y, most = F.col("a_norm"), F.col("b_norm"), F.col("limit")
    apart_by = F.when(F.abs(F.length(x) - F.length(y)) > most, F.lit(-1)).when(_beyond(x, y, most), F.lit(-1)).otherwise(_distance(x, y, most))
    between = written(fenced(both, F.col("a"), F.col("b"), F.greatest(F.length(x), F.length(y)).alias("len"), apart_by.alias("between")).where("between >= 0"), "between")
    like = F.col("between") <= _allowed(similarity, "len", "len")
    groups = _regrouped(groups, between.where(like).select("a", "b"))
    members = written(_placed(apart.drop("component"), groups), "members")
    a, b = (members.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in members.columns if c != "bucket"], F.col("leader").alias(side)) for side in "ab")
    open_pairs = two.select("bucket", "a", "b").join(between.where(~like).select("a", "b", "between"), ["a", "b"])
    lens = F.least("a_len", "b_len") >= F.greatest("a_len", "b_len") * similarity
    left = lens & (F.col("a_component") != F.col("b_component")) & (F.col("between") - F.col("a_far") - F.col("b_far") <= _allowed(similarity, "a_len", "b_len"))
    rest = open_pairs.join(a, ["bucket", "a"]).join(b, ["bucket", "b"]).where(left)
    rest = rest.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if rest.isEmpty():
        return groups
    return _regrouped(groups, written(measured_pairs(_with_texts(rest, texts), similarity).select("a", "b"), "more"))


def line_groups(found: DataFrame, similarity: float) -> DataFrame:
    """node, component: distinct lines (by key) that are linked to others."""
    lines = found.select("key", "norm").groupBy("key").agg(F.first("norm").alias("norm"))
    tiny = found.select("key", "norm").where(F.length("norm") <= TINY).distinct()
    blocks = written(block_keys(lines, BLOCK_WORDS, similarity, few=True).unionByName(tiny_keys(tiny, similarity)), "blocks")
    release(found.sparkSession)
    buckets = blocks.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    buckets = written(buckets.select("bucket", "first"), "buckets")
    release(found.sparkSession)
    met = written(maybe_in(blocks, "bucket", key_filter(buckets, "bucket")).join(buckets, "bucket"), "met")
    drop_written(blocks, buckets)
    pairs = written(met.where("key <> first").select(F.least("key", "first").alias("a"), F.greatest("key", "first").alias("b")).distinct(), "pairs")
    links, texts = _verified(found, pairs, similarity)
    return rest_of_buckets(met.select("bucket", "key", "len"), links, components(links), pairs, texts, similarity)


def dropped_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """k_id, k_text, drop (line numbers) of every document with a line that another occurrence stands for; written."""
    with temporaries(docs.sparkSession):
        found = written(occurrences(docs), "occurrences")
        groups = line_groups(found, similarity)
        place = F.struct("k_id", "k_text", "line_no")
        per_key = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        per_key = per_key.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
        per_key = written(per_key.select("key", "group", "first", "last"), "groups")
        best = per_key.groupBy("group").agg(F.min("first").alias("stays"), F.max("last").alias("end")).where("stays <> end")
        keepers = per_key.select("key", "group").join(best, "group").select("key", "stays")
        drops = found.select("k_id", "k_text", "line_no", "key").join(keepers, "key").where(place != F.col("stays"))
        return written(drops.groupBy("k_id", "k_text").agg(F.collect_set("line_no").alias("drop")), "drops", keep=True)


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with the lines that others stand for taken out of text, and n_lines, n_dropped (lines with a word)."""
    drops = dropped_lines(docs, similarity)
    release(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    k_id, k_text, drop = spare(docs, "k_id", "k_text", "drop")
    ids, text_hash = doc_key()
    keyed = docs.withColumns({k_id: ids, k_text: text_hash})
    drops = drops.select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text), F.col("drop").alias(drop))
    keyed = keyed.join(drops, [k_id, k_text], "left")
    lines = F.split("text", "\n")
    stays = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda i: F.get(lines, i)), "\n")
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0))
    return keyed.select(
        *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(stays).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))
