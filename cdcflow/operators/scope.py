"""Which rows a user may see, and labels of coded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised


def descendants(depts: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, dept_id: each root, and every department that lists it among its ancestors (a comma list)."""
    lines = depts.select("dept_id", F.explode(F.array_distinct(F.concat(F.split(F.coalesce("ancestors", F.lit("")), ","), F.array(F.col("dept_id").cast("string"))))).alias("a"))
    return lines.join(roots.select(F.col("root_id"), F.col("root_id").cast("string").alias("a")), "a").select("root_id", "dept_id").distinct()


def ancestors(depts: DataFrame) -> DataFrame:
    """dept_id, ancestor_id, distance: every ancestor of every department (dept_id, parent_id), 1 for its parent. A circle of parents is an error; a parent that is no department has none.

    Each round doubles the steps that are known, so rounds grow with the logarithm of the depth; a department that has nothing further up leaves.
    """
    jump = materialised(depts.select("dept_id", F.col("parent_id").alias("ancestor_id")).where("ancestor_id is not null").distinct(), "jump")
    known, step = materialised(jump.withColumn("distance", F.lit(1).cast("long")), "known"), 1
    n = jump.count()
    while not jump.isEmpty():
        if step > n:
            raise ValueError("the departments' parents run in a circle")
        far = jump.select(F.col("dept_id").alias("from_id"), F.col("ancestor_id").alias("mid"))
        more = known.select(F.col("dept_id").alias("mid"), F.col("ancestor_id"), F.col("distance"))
        known = materialised(known.unionByName(far.join(more, "mid").select(F.col("from_id").alias("dept_id"), "ancestor_id", (F.col("distance") + step).alias("distance"))), "known")
        onward = jump.select(F.col("dept_id").alias("mid"), "ancestor_id")
        jump = materialised(far.join(onward, "mid").select(F.col("from_id").alias("dept_id"), "ancestor_id"), "jump")
        step *= 2
    return known


def descendants_by_parent(depts: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, dept_id: each root that is a department, and every department below it, from parents (dept_id, parent_id)."""
    lines = ancestors(depts).select(F.col("ancestor_id").alias("root_id"), "dept_id").unionByName(depts.select(F.col("dept_id").alias("root_id"), "dept_id"))
    return lines.join(roots.select("root_id").distinct(), "root_id").distinct()


def visible_rows(rows: DataFrame, scopes: list[dict], depts: DataFrame, user_id: int) -> DataFrame:
    """Rows (dept_id, owner_id) that any of the scopes allows; none allows none.

    A scope is {"kind": ALL | CUSTOM | DEPT | DEPT_AND_CHILDREN | SELF | DEPT_AND_CHILDREN_OR_SELF, "depts": [...]}.
    """
    if any(s["kind"] == "ALL" for s in scopes):
        return rows
    spark = rows.sparkSession
    whole = [d for s in scopes if s["kind"].startswith("DEPT_AND_CHILDREN") for d in s["depts"]]
    plain = [d for s in scopes if s["kind"] in ("CUSTOM", "DEPT") for d in s["depts"]]
    allowed = spark.createDataFrame([(d,) for d in plain], "dept_id long")
    if whole:
        allowed = allowed.unionByName(descendants(depts, spark.createDataFrame([(d,) for d in whole], "root_id long")).select("dept_id"))
    marked = rows.join(allowed.distinct().withColumn("ok", F.lit(True)), "dept_id", "left")
    own = F.lit(any(s["kind"] in ("SELF", "DEPT_AND_CHILDREN_OR_SELF") for s in scopes)) & (F.col("owner_id") == user_id)
    return marked.where(F.coalesce("ok", F.lit(False)) | F.coalesce(own, F.lit(False))).select(*rows.columns)


def with_labels(df: DataFrame, row_key: list[str], codes: Column, dictionary: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df with `name`: the labels of a comma list of codes, joined by commas in the list's order; a code without a label is left out.

    row_key: columns that tell the rows of df apart. dictionary: code, label. Up to `most` entries are broadcast as one map-like side; more are joined by a shuffle.
    """
    each = df.select(*row_key, F.posexplode(F.split(codes, ",")).alias("_at", "_code")).withColumn("_code", F.trim("_code"))
    small = dictionary.limit(most + 1).count() <= most
    d = dictionary.select(F.col("code").alias("_code"), "label")
    found = each.join(F.broadcast(d) if small else d, "_code")
    joined = found.groupBy(*row_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "label"))), lambda x: x["label"]), ",").alias(name))
    return df.join(joined, row_key, "left")


def label_of(codes: Column, dictionary: dict[str, str]) -> Column:
    """Labels of a comma list of codes from a small fixed dictionary, without a join."""
    pairs = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.array_join(F.filter(F.transform(F.split(codes, ","), lambda c: F.try_element_at(pairs, F.trim(c))), lambda x: x.isNotNull()), ",")
