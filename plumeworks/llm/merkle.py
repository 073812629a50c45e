"""Merkle manifest of a dataset by bitmap ranks (operator 13).

Every row is a leaf; the leaves of a group (a source) form a tree of 16 children
a node, and the groups' roots form one more. A leaf's place in its group is a
rank query: the ids of a group are merged into a bitmap of 64-bit words, of which
only those that hold an id are kept, and a directory of popcounts says how many
ids stand before a word. The directory has levels of 2^16 ids, 2^32 and 2^48, so
that no task sums more than 65,536 entries. Leaves look up their word and count
the lower bits; they are never sorted.

Levels are reduced by key: places divided by 16 name the node, the remainder is
the slot in the node's array, and H of the array is the node above. Proofs come
down again the same way: a node's path is its siblings and then its parent's
path, so only the last step, within one row, is as wide as the table.

Cases: null fields are `-` in a leaf. Rows without an id come first in their
group, rows without a group form the first group. Rows that share group and id
stand next to each other in the order of their leaves: such rows, and only they,
are dealt by ranges and numbered there, so that one id may hold any share of the
rows. Repeated rows are leaves like others. Empty tables give no row. Ids must be
whole numbers, else TypeError. Texts of any length are hashed whole. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, partitions, stored

FAN = 16
#: The word of rows without an id: one below the least.
NO_ID = -(1 << 58) - 1
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H of the parts, one after the other."""
    return F.sha2(F.concat(*parts) if parts else F.lit(""), 256)


def field(column: Column) -> Column:
    """A value as it stands in a leaf: its bytes in UTF-8, a colon, the value; `-` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*(field(c) for c in columns))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings (left, right) by level lead to."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def in_order(rows: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Rows with their `place` from 0 within the group `within` by `order`, which begins with it; no task sees a whole group."""
    parts = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered")
    firsts = dealt.groupBy(*within, "part").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_part"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("before", F.coalesce(F.sum("n_part").over(before), F.lit(0)))
    placed = dealt.join(firsts, [*within, "part"])
    return placed.withColumn("place", F.expr("seq - first_seq + before")).select(*rows.columns, "place")


def _summed_before(rows: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
    window = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum("n").over(window), F.lit(0)))


def rank_index(words: DataFrame) -> DataFrame:
    """The popcount directory: words (grp, h, word, n) with `base`, the rows of the group before the word, and `total`."""
    levels = words.select("grp", "h", "word", "n", F.shiftright("h", 10).alias("c1"), F.shiftright("h", 26).alias("c2"), F.shiftright("h", 42).alias("c3"))
    first = levels.groupBy("grp", "c3", "c2", "c1").agg(F.sum("n").alias("n"))
    second = first.groupBy("grp", "c3", "c2").agg(F.sum("n").alias("n"))
    third = second.groupBy("grp", "c3").agg(F.sum("n").alias("n"))
    total = third.groupBy("grp").agg(F.sum("n").alias("total"))
    base = _summed_before(third, ["grp"], "c3", "b3").drop("n").join(total, "grp")
    base = _summed_before(second, ["grp", "c3"], "c2", "b2").drop("n").join(base, ["grp", "c3"])
    base = _summed_before(first, ["grp", "c3", "c2"], "c1", "b1").drop("n").join(base, ["grp", "c3", "c2"])
    rows = _summed_before(levels, ["grp", "c3", "c2", "c1"], "h", "b0").join(base, ["grp", "c3", "c2", "c1"])
    return rows.select("grp", "h", "word", F.expr("b0 + b1 + b2 + b3").alias("base"), "total")


def ranked(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """Leaves (grp, h, bit, doc_id, leaf, ...) with `place` in their group and its `total`.

    keys: (grp, h, bit) of the same rows, read apart, as it needs no text.
    """
    words = keys.groupBy("grp", "h").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"), F.count("*").alias("n"))
    words = stored(words, "words")
    index = rank_index(words)
    lower = F.expr("base + bit_count(word & ~shiftleft(-1L, bit))")
    doubled = words.where("n > bit_count(word)").select("grp", "h")
    if doubled.isEmpty():
        return leaves.join(index, ["grp", "h"]).withColumn("place", lower).drop("word", "base")
    many = keys.join(doubled, ["grp", "h"], "left_semi").groupBy("grp", "h", "bit").agg(F.count("*").alias("n")).where("n > 1")
    many = stored(many, "repeated")
    extra = many.groupBy("grp", "h").agg(F.collect_list(F.struct("bit", (F.col("n") - 1).alias("more"))).alias("extra"))  # 64 at most
    index = index.join(extra, ["grp", "h"], "left")
    lower = lower + F.expr("coalesce(aggregate(filter(extra, e -> e.bit < bit), 0L, (s, e) -> s + e.more), 0L)")
    single = leaves.join(many.drop("n"), ["grp", "h", "bit"], "left_anti").withColumn("turn", F.lit(0).cast("long"))
    again = leaves.join(many.drop("n"), ["grp", "h", "bit"], "left_semi").withColumn("uid", F.monotonically_increasing_id())
    again = in_order(again, ["grp", "h", "bit", "leaf", "uid"], ["grp", "h", "bit"]).drop("uid").withColumnRenamed("place", "turn")
    both = single.unionByName(again).join(index, ["grp", "h"])
    return both.withColumn("place", lower + F.col("turn")).drop("word", "base", "extra", "turn")


def _gathered(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (grp, place, digest, n) as slot arrays: (grp, place, kids, n) one level up, n still of the level below."""
    rows = nodes.groupBy("grp", F.expr(f"place div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct((F.col("place") % FAN).cast("int").alias("slot"), "digest"))).alias("slots"), F.any_value("n").alias("n"))
    return stored(rows.select("grp", F.col("up").alias("place"), F.col("slots.digest").alias("kids"), "n"), name)


def _above(groups: DataFrame) -> DataFrame:
    """The nodes that slot arrays make."""
    return groups.select("grp", "place", digest(F.array_join("kids", "")).alias("digest"), F.expr(f"cast(ceil(n / {FAN}) as bigint)").alias("n"))


def step(kids: Column, slot: Column) -> Column:
    """What stands left and right of a slot."""
    return F.struct(F.array_join(F.slice(kids, 1, slot), "").alias("left"), F.array_join(F.slice(kids, slot + 2, FAN), "").alias("right"))


def reduce_levels(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Subroots (grp, digest), the slot arrays of each level, and the nodes that were alone in their group at each level.

    most: the nodes of the largest group.
    """
    alone, levels = [nodes.where("n = 1")], []
    while most > 1:
        levels.append(_gathered(nodes.where("n > 1"), f"level{len(levels)}"))
        nodes, most = _above(levels[-1]), -(-most // FAN)
        alone.append(nodes.where("n = 1"))
    tops = alone[0]
    for more in alone[1:]:
        tops = tops.unionByName(more)
    return stored(tops.select("grp", "digest"), "tops"), levels, alone


def paths(levels: list[DataFrame], alone: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The path of every node of the lowest level: tops (grp, path, ...) hold how it goes on above a group."""
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    found = alone[-1].select("grp", "place").join(tops, "grp")
    for level, ended in zip(reversed(levels), reversed(alone[:-1]), strict=True):
        rows = level.join(found, ["grp", "place"]).select("grp", "place", "kids", "path", *carried, F.explode(F.expr("sequence(0, size(kids) - 1)")).alias("slot"))
        rows = rows.select("grp", (F.col("place") * FAN + F.col("slot")).alias("place"), F.concat(F.array(step(F.col("kids"), F.col("slot"))), "path").alias("path"), *carried)
        found = rows.unionByName(ended.select("grp", "place").join(tops, "grp").select(*rows.columns))
    return found


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source", **also: Column) -> DataFrame:
    """One row per row: doc_id, place (in its group), leaf, subroot, root, path (siblings left and right, by level up to the root), and the columns of `also`.

    A verifier holds fold(path, leaf) against root.
    """
    kind = id_type(docs, key)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; bitmaps are over whole numbers")
    number = F.col(key).cast("long")
    where = [
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("grp"),  # null first
        F.coalesce(F.shiftright(number, 6), F.lit(NO_ID)).alias("h"),
        F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
    ]
    extra = [f"also_{c}" for c in also]
    leaves = docs.select(*where, F.col(key).alias("doc_id"), leaf(*(F.col(c) for c in fields)).alias("leaf"), *(v.alias(n) for n, v in zip(extra, also.values(), strict=True)))
    rows = ranked(leaves, docs.select(*where))
    kids = F.array_sort(F.collect_list(F.struct((F.col("place") % FAN).cast("int").alias("slot"), "doc_id", "leaf", *extra)))
    runs = stored(rows.groupBy("grp", F.expr(f"place div {FAN}").alias("run")).agg(kids.alias("rows"), F.any_value("total").alias("n")).withColumnRenamed("run", "place"), "runs")
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        most = 0
    lowest = runs.select("grp", "place", F.when(F.col("n") == 1, F.col("rows")[0]["leaf"]).otherwise(digest(F.array_join("rows.leaf", ""))).alias("digest"), F.expr(f"cast(ceil(n / {FAN}) as bigint)").alias("n"))
    tops, levels, alone = reduce_levels(lowest, -(-most // FAN))
    sources = in_order(tops.withColumn("all", F.lit("")), ["all", "grp"], ["all"])
    n_sources = tops.count()
    nodes = stored(sources.select(F.lit("").alias("grp"), "place", "digest", F.lit(n_sources).cast("long").alias("n"), F.col("grp").alias("source_grp")), "sources")
    over, upper, single = reduce_levels(nodes.drop("source_grp"), n_sources)
    root = over.first()
    root = F.lit(root["digest"] if root else None).cast("string")
    begin = over.select("grp", F.array().cast(PATH).alias("path"))
    by_source = paths(upper, single, begin).join(nodes.drop("grp", "n"), "place").select(F.col("source_grp").alias("grp"), "path", F.col("digest").alias("subroot"))
    by_run = paths(levels, alone, by_source)
    found = runs.join(by_run, ["grp", "place"]).select("place", "rows", "n", "path", "subroot", F.posexplode("rows").alias("slot", "own"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(step(F.col("rows.leaf"), F.col("slot"))), "path"))
    return found.select(F.col("own.doc_id").alias("doc_id"), (F.col("place") * FAN + F.col("slot")).alias("place"), F.col("own.leaf").alias("leaf"), "subroot", root.alias("root"), path.alias("path"), *(F.col(f"own.also_{c}").alias(c) for c in also))


def lowered(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents held against a copy in which every fifth id, by its checksum, has its text in lower case."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    changed = F.when(tampered, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered(F.col("text"))))
    rows = manifest(docs, changed=changed)
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), fold(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
