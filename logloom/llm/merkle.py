"""Merkle manifest of a dataset: bitmaps of ids, ranks from them, and trees of slot arrays.

Every row is a leaf: the digest of its columns. The leaves of a group (a language) stand
in the order of their ids; 8 neighbours at a time become a node, until one is left; the groups' last
nodes, in the order of the groups, make a tree in the same way.

A leaf's place is a rank query, not a sort: the ids of a group are a bitmap in words of 64
(only words with an id are kept, and tasks combine theirs before the shuffle), a running
sum over the words' popcounts is the directory, and the rank of an id is the
directory's entry of its word and the popcount of the bits below it. Only ids that
a bitmap cannot tell apart, repeated and null ones, are put in order by their digests, equal rows
counted as one entry; of them too no task sees all.

Leaves then go to slot arrays of 512, keyed by group and rank / 512, which climb three levels in
one task, and so do the nodes, 512 at a time, until each group has one. Down again, a
slot array gets the siblings above it, and each leaf its own proof: no row carries siblings through a shuffle.

Defined results: null ids come first, then ids ascending, equal ids by digest; repeated rows are
leaves of their own in neighbouring slots; the null group comes first, the
others by UTF-8 bytes; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map, cut
from logloom.plans.durable import running_total, scratch

#: Nodes that become one; levels that a slot array climbs; its slots.
FAN, LEVELS = 8, 3
SLOTS = FAN**LEVELS
#: Word of rows without an id: before all words of ids.
NO_ID = -(1 << 60)


def digest(*columns: str, text: Column | None = None) -> Column:
    """H of columns: ``-`` for null, else UTF-8 byte count, ``:`` and the value. ``text`` stands for the column of that name."""
    parts = []
    for c in columns:
        value = text if c == "text" and text is not None else F.col(c).cast("string")
        parts.append(F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_az(c: Column) -> Column:
    """A-Z alone lower-cased; texts of ASCII take the quicker way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and those of each level above."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_h(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def _depth(n: int) -> int:
    """Levels that n nodes climb within one slot array: to the last node, or LEVELS if there are more arrays."""
    levels, width = 0, 1
    while width < n and levels < LEVELS:
        levels, width = levels + 1, width * FAN
    return levels


def _siblings(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(those to the left, those to the right), put together, at each level."""
    out = []
    for nodes in tree[:-1]:
        a = i - i % FAN
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + FAN])))
        i //= FAN
    return out


def _bit(doc_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), doc_id.bitwiseAND(F.lit(63)).cast("int"))


def directory(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (grp, word, bits, n, before) and groups (grp, total, first) of ``ids`` (grp, word, doc_id).

    ``n`` counts rows, ``before`` those of the words before, over all groups; a group's first word has ``first``.
    """
    words = ids.groupBy("grp", "word").agg(F.coalesce(F.bit_or(_bit(F.col("doc_id"))), F.lit(0)).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = cut(running_total(words, ["grp", "word"], "n", "before"))
    return words, words.groupBy("grp").agg(F.sum("n").alias("total"), F.min("before").alias("first"))


def ranked(leaves: DataFrame, words: DataFrame, groups: DataFrame) -> DataFrame:
    """``leaves`` (grp, word, doc_id, leaf, tampered) with slot, copies and total: the leaf's rank in its group, rows that are equal to it, leaves of the group."""
    entries = words.join(groups, "grp").select("grp", "word", "bits", "total", (F.col("before") - F.col("first")).alias("base"), (F.col("n") > F.bit_count("bits")).alias("shared"))
    found = leaves.join(entries, ["grp", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")))))
    columns = ["grp", "doc_id", "leaf", "tampered", "total"]
    alone = found.where("NOT shared").select(*columns, (F.col("base") + below).alias("slot"), F.lit(1).cast("long").alias("copies"))
    if not words.where(F.col("n") > F.bit_count("bits")).limit(1).count():
        return alone
    # Rows of words with repeated or null ids: equal rows are one entry, a running total puts the entries in order.
    entries = found.where("shared").groupBy("grp", "word", "doc_id", "leaf", "tampered", "total", "base").agg(F.count(F.lit(1)).alias("copies"))
    placed = running_total(entries, ["grp", "word", "doc_id", "leaf"], "copies", "at")
    starts = placed.groupBy("grp", "word").agg(F.min("at").alias("start"))
    shared = placed.join(starts, ["grp", "word"]).select(*columns, (F.col("base") + F.col("at") - F.col("start")).alias("slot"), "copies")
    return alone.unionByName(shared)


def slot_arrays(rows: DataFrame) -> DataFrame:
    """grp, block, total, slots (slot in the block, n, doc_id, leaf, tampered): leaves by blocks of SLOTS; copies over several blocks are dealt to each."""
    last = F.col("slot") + F.col("copies") - 1
    one = rows.where(F.floor(F.col("slot") / SLOTS) == F.floor(last / SLOTS)).withColumn("block", F.floor(F.col("slot") / SLOTS))
    many = rows.where(F.floor(F.col("slot") / SLOTS) < F.floor(last / SLOTS)).withColumn("block", F.explode(F.sequence(F.floor(F.col("slot") / SLOTS), F.floor(last / SLOTS))))
    low, high = F.col("block") * SLOTS, (F.col("block") + 1) * SLOTS - 1
    start = F.greatest("slot", low)
    n = F.least(last, high) - start + 1
    slot = F.struct((start - low).cast("int").alias("slot"), n.cast("int").alias("n"), "doc_id", "leaf", "tampered")
    return one.unionByName(many).select("grp", "block", "total", slot.alias("s")).groupBy("grp", "block").agg(F.first("total").alias("total"), F.collect_list("s").alias("slots"))


_PATH = "array<struct<left: string, right: string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _per_row(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``fn`` of each row, one row at a time in memory as Python objects."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                out = fn({c: b.column(c)[i].as_py() for c in b.schema.names})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return arrow_map(df, run, schema)


def _leaf_list(slots: list[dict]) -> list[dict]:
    """One entry per leaf, by slot."""
    return [s for s in sorted(slots, key=lambda s: s["slot"]) for _ in range(s["n"])]


def _array_tops(arrays: DataFrame) -> DataFrame:
    """Of arrays of leaves: tree, idx, n (nodes of the tree on this level), node."""

    def top(row):
        nodes = [s["leaf"].hex() for s in _leaf_list(row["slots"])]
        return [{"tree": row["grp"], "idx": row["block"], "n": -(-row["total"] // SLOTS), "node": _climb(nodes, _depth(row["total"]))[-1][0]}]

    return _per_row(arrays.select("grp", "block", "total", "slots"), top, "tree string, idx long, n long, node string", pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree, idx, n, node), n nodes in their tree: tops (tree, node) and paths (tree, idx, path), the siblings from each node up to its top.

    Rounds are as many as slot arrays lie above one another: two for a quarter of a million nodes.
    """
    arrays = nodes.groupBy("tree", F.floor(F.col("idx") / SLOTS).alias("block")).agg(F.first("n").alias("n"), F.collect_list(F.struct((F.col("idx") % SLOTS).alias("slot"), "node")).alias("slots"))

    def up(row):
        tree = _climb([s["node"] for s in sorted(row["slots"], key=lambda s: s["slot"])], _depth(row["n"]))
        base = {"tree": row["tree"], "block": row["block"], "n": -(-row["n"] // SLOTS), "node": tree[-1][0]}
        return [base | {"idx": row["block"] * SLOTS + i, "path": [{"left": a, "right": b} for a, b in _siblings(tree, i)]} for i in range(len(tree[0]))]

    schema = f"tree string, block long, n long, node string, idx long, path {_PATH}"
    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("idx", pa.int64()), ("path", _PATH_TYPE)])
    found = cut(_per_row(arrays, up, schema, arrow))
    tops = found.where(F.col("idx") % SLOTS == 0).select("tree", F.col("block").alias("idx"), "n", "node")
    paths = found.select("tree", "idx", "block", "path")
    if not tops.where("n > 1").limit(1).count():
        return tops.select("tree", "node"), paths.drop("block")
    above, upper = climb(tops)
    joined = paths.join(upper.select("tree", F.col("idx").alias("block"), F.col("path").alias("upper")), ["tree", "block"])
    return above, joined.select("tree", "idx", F.concat("path", "upper").alias("path"))


def manifest(docs: DataFrame, group: str, columns: list[str], tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; and grp and slot, the leaf's place.

    ``tampered`` says of which rows the text is checked with A-Z lower-cased: their
    digest is folded with the original siblings.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp")  # null first
    doc_id = F.col("doc_id").cast("long")
    word = F.coalesce(F.shiftright(doc_id, 6), F.lit(NO_ID)).alias("word")
    words, groups = directory(docs.select(key, word, doc_id.alias("doc_id")))
    other = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").isNotNull(), F.unhex(digest(*columns, text=lower_az(F.col("text").cast("string")))))
    leaves = docs.select(key, word, doc_id.alias("doc_id"), F.unhex(digest(*columns)).alias("leaf"), other.alias("tampered"))
    path = scratch(spark, "leaves")
    slot_arrays(ranked(leaves, words, groups)).write.parquet(path)
    arrays = spark.read.schema("grp string, block long, total long, slots array<struct<slot: int, n: int, doc_id: bigint, leaf: binary, tampered: binary>>").parquet(path)
    tops, paths = climb(_array_tops(arrays))
    numbered = running_total(tops.withColumn("one", F.lit(1).cast("long")), ["tree"], "one", "place")
    n_groups = numbered.count()
    roots, group_paths = climb(numbered.select(F.lit("").alias("tree"), F.col("place").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "node"))
    above = numbered.join(group_paths.select(F.col("idx").alias("place"), F.col("path").alias("upper")), "place").crossJoin(F.broadcast(roots.select(F.col("node").alias("root"))))
    full = paths.join(above.select("tree", F.col("node").alias("subroot"), "root", "upper"), "tree")
    full = full.select(F.col("tree").alias("grp"), F.col("idx").alias("block"), "subroot", "root", F.concat("path", "upper").alias("path"))

    def prove(row):
        leaves = _leaf_list(row["slots"])
        tree = _climb([s["leaf"].hex() for s in leaves], _depth(row["total"]))
        upper = [(p["left"], p["right"]) for p in row["path"]]
        above = "".join(a + b for a, b in upper)
        out = []
        for i, s in enumerate(leaves):
            siblings = _siblings(tree, i)
            now = (s["tampered"] or s["leaf"]).hex()
            for a, b in siblings + upper:
                now = _h([a, now, b])
            out.append(
                {
                    "doc_id": s["doc_id"], "leaf": s["leaf"].hex(), "subroot": row["subroot"], "root": row["root"], "proof_sha256": _h([a + b for a, b in siblings] + [above]),
                    "folded_root": now, "verified": now == row["root"], "grp": row["grp"][1:] if row["grp"] else None, "slot": row["block"] * SLOTS + i,
                }
            )
        return out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, grp string, slot long"
    text = pa.string()
    arrow = pa.schema([("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("verified", pa.bool_()), ("grp", text), ("slot", pa.int64())])
    return _per_row(arrays.join(full.hint("shuffle_hash"), ["grp", "block"]), prove, schema, arrow)
