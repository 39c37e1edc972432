"""Near-duplicate classes by BagMinHash banding and verified multiset overlap.

1. One pass over the texts gives each row the digest of its bag of word
   shingles and the band hashes of its BagMinHash signature. Rows with equal digests are
   one node; all that follows is about nodes, so thousands of exact copies cost one.
2. Nodes that share a band hash are in one bucket. Every bucket has a random
   centre, and each member is verified against it: as many pairs as members,
   however large the bucket.
3. Verified pairs are joined to components. A bucket all of whose members are
   in one component is settled. The others hold pairs that no centre has
   decided; they are gone through exactly, in tiles: members are dealt into blocks
   (TILE to MAX_TILE members, BLOCKS of them in between, so that a member is copied into 16 tiles
   at most up to 65 000 members), a task gets two blocks, compares signatures, and verifies the
   pairs of different components whose estimated similarity is within
   SLACK of the threshold. No pair of a tile leaves it but a found link. A component
   that fills a block has blocks of its own, which meet the blocks of the other members
   but not each other: a huge group of near copies and a few strangers in its bucket
   are as many tiles as the group has blocks, a member of the group in one of them.
4. Components of all links are the classes.

So no link between nodes that share a bucket is lost, but for the slack of the
estimate (four standard deviations: below 1 in 10 000 of the pairs that are just at the
threshold, none worth naming above 0.83) and the recall of the bands: with
BANDS x ROWS = 28 x 8 a pair of similarity 0.8 shares a bucket with
probability 0.994, one of 0.85 with 0.9999.

Defined results: null and empty texts have the empty bag and are one class;
texts of less than five words are one shingle; repeated rows are exact copies; the
class id is the smallest doc_id of the class (null if all are null); ties
go to the smallest doc_id, then the first row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import bagminhash as bm
from logloom.llm.common import arrow_map, cut

#: Similarity of near duplicates; members of a tile's block, least and most, and blocks of a bucket between them.
THRESHOLD, TILE, MAX_TILE, BLOCKS = 0.8, 512, 4096, 16
#: Share of all links from which on a node is a hub.
HUB_SHARE = 0.001
#: Below the threshold by this much an estimate still gets verified: four standard deviations of SLOTS slots.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / bm.SLOTS)


def _with_least(rows: DataFrame, keyed: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` (u, v) with m, the least neighbour of u, which ``keyed`` (u, n, m) has for every u.

    A node with more than a HUB_SHARE of all links is a hub; there are at most
    2 / HUB_SHARE of them, so they are broadcast and their links stay where they are.
    """
    limit = max(1000, int(n_edges * HUB_SHARE))
    hubs = F.broadcast(keyed.where(F.col("n") > limit).select("u", "m"))
    others = keyed.where(F.col("n") <= limit).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node of its component.

    Alternating large-star and small-star steps until the links stand still;
    each step is grouped minima and joins, nothing comes to the driver but a count
    and a checksum.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before, n = None, edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m")))
        large = cut(_with_least(both, least, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")))
        moved = _with_least(large, least, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of the components of ``labels`` joined by the links ``more`` (a, b): components of labels alone, as many links as tiles have found, none at all mostly."""
    if not more.limit(1).count():
        return labels
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    ends = more.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    over = cut(components(ends).select(F.col("node").alias("label"), F.col("label").alias("least")))
    alone = over.select(F.col("label").alias("node"), F.col("least").alias("label")).join(labels.select("node"), "node", "left_anti")
    return labels.join(over, "label", "left").select("node", F.coalesce("least", "label").alias("label")).unionByName(alone)


def _steps(texts: list[str | None]) -> Iterator[tuple[list, int]]:
    """Bags of runs of texts with a bounded number of shingles together, and the place of the first."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = bm.bag(bm.word_hashes(t))
        if part and size + len(b[0]) > bm.STEP_SHINGLES:
            yield part, first
            part, size, first = [], 0, i
        part.append(b)
        size += len(b[0])
    if part:
        yield part, first


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, digest, bands of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches):
        for b in batches:
            digests, all_bands = [], []
            for bags, _ in _steps(b.column("text").to_pylist()):
                digests += [bm.digest(x) for x in bags]
                all_bands += list(bm.bands(bm.signatures(bags)))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("text_key"), pa.array(digests, pa.binary()), pa.array(all_bands, pa.list_(pa.int64()))],
                names=["row", "doc_id", "text_key", "digest", "bands"],
            )

    return arrow_map(rows, run, "row long, doc_id long, text_key long, digest binary, bands array<long>")


def _bag_bytes(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Shingles, and multiplicities behind them where some is not 1."""
    return b[0].tobytes() + (b[1].astype(np.uint32).tobytes() + b"+" if (b[1] > 1).any() else b"")


def _bag_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) % 8 == 0:
        h = np.frombuffer(raw, np.uint64)
        return h, np.ones(len(h), dtype=np.int64)
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _slots(signature: np.ndarray) -> bytes:
    """16 bits of each slot: enough to estimate a similarity."""
    return (bm.mix(signature.view(np.uint64)) >> np.uint64(48)).astype(np.uint16).tobytes()


def fetch_bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, bag, signature of the ``wanted`` nodes (node, doc_id, text_key); texts come from ``docs`` again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).alias("d")
    w = wanted.select("node", "doc_id", "text_key").alias("w")
    same = (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    joined = rows.join(w, same).select("w.node", "d.text")

    def run(batches):
        for b in batches:
            out_bags, out_signatures = [], []
            for bags, _ in _steps(b.column("text").to_pylist()):
                out_bags += [_bag_bytes(x) for x in bags]
                out_signatures += [_slots(s) for s in bm.signatures(bags)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out_bags, pa.binary()), pa.array(out_signatures, pa.binary())], names=["node", "bag", "signature"])

    return arrow_map(joined, run, "node long, bag binary, signature binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of ``pairs`` (a, b) whose bags have at least the threshold's weighted Jaccard similarity."""
    one, two = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))

    def run(batches):
        for b in batches:
            a_ids, b_ids, last, bag = b.column("a").to_pylist(), b.column("b").to_pylist(), None, None
            found = []
            for x, y, p, q in zip(a_ids, b_ids, b.column("bag_a").to_pylist(), b.column("bag_b").to_pylist()):
                if x != last:
                    last, bag = x, _bag_of(p)
                inter, union = bm.overlap(bag, _bag_of(q))
                if inter >= threshold * union:
                    found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return arrow_map(pairs.join(two, "b").join(one, "a"), run, "a long, b long")


def _tile_links(nodes: list[int], sides: list[int], labels: list[int], bags: list[bytes], signatures: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links that join different components within one tile; sides tells the block in a tile of two."""
    sig = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(nodes), -1)
    parent = {x: x for x in labels}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    side, label = np.array(sides), np.array(labels)
    two = side.min() != side.max()
    candidates = []
    for i in range(len(nodes)):
        others = np.arange(i + 1, len(nodes)) if not two else np.flatnonzero(side > side[i])
        others = others[label[others] != label[i]]
        if len(others):
            like = (sig[others] == sig[i]).mean(axis=1)
            candidates += [(-float(s), i, int(j)) for s, j in zip(like, others) if s >= threshold - SLACK]
    links, known = [], {}
    for _, i, j in sorted(candidates):
        x, y = find(labels[i]), find(labels[j])
        if x == y:
            continue
        for k in (i, j):
            if k not in known:
                known[k] = _bag_of(bags[k])
        inter, union = bm.overlap(known[i], known[j])
        if inter >= threshold * union:
            parent[max(x, y)] = min(x, y)
            links.append((nodes[i], nodes[j]))
    return links


def tile_links(open_members: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between different components in ``open_members`` (band, n, node, label, main, n_main); main is the component with most members."""
    tile = F.least(F.greatest(F.col("n") / BLOCKS, F.lit(TILE)), F.lit(MAX_TILE))
    apart = F.when(F.col("n_main") >= tile, F.col("n_main")).otherwise(0)
    mixed, own = F.ceil((F.col("n") - apart) / tile).cast("int"), F.ceil(apart / tile).cast("int")
    draw, in_main = F.xxhash64("node", "band"), (F.col("own") > 0) & F.col("label").eqNullSafe(F.col("main"))
    tiles = open_members.withColumns({"mixed": mixed, "own": own}).select(
        "band", "node", "label",
        F.when(in_main, F.col("mixed") + F.pmod(draw, F.greatest("own", F.lit(1)))).otherwise(F.pmod(draw, F.col("mixed"))).cast("int").alias("mine"),
        F.when(in_main, F.col("mixed")).otherwise(F.col("mixed") + F.col("own")).alias("others"),
    )
    tiles = tiles.join(bags, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    tiles = tiles.select("band", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"), "mine", "node", "label", "bag", "signature")
    keyed = tiles.repartition("band", "ti", "tj").sortWithinPartitions("band", "ti", "tj")

    def run(batches):
        key, held = None, []

        def close():
            if len(held) > 1:
                return _tile_links([h[1] for h in held], [h[0] for h in held], [h[2] for h in held], [h[3] for h in held], [h[4] for h in held], threshold)
            return []

        for b in batches:
            found = []
            columns = [b.column(c).to_pylist() for c in ("band", "ti", "tj", "mine", "node", "label", "bag", "signature")]
            for band, ti, tj, mine, node, label, bag, signature in zip(*columns):
                if (band, ti, tj) != key:
                    found += close()
                    key, held = (band, ti, tj), []
                held.append((mine, node, label, bag, signature))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        if found := close():
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return arrow_map(keyed, run, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row, doc_id, text_key, class_id, class_size, is_kept of every row of ``docs`` (doc_id, text).

    ``is_kept`` is true for one row of each class, the first with the
    class id. ``row`` numbers the rows of this scan.
    """
    rows = cut(scan(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key"))
    nodes = cut(
        rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
        .select("digest", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "n", "bands")
    )
    members = nodes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "band")).alias("centre")).where("n > 1")
    members = cut(members.join(buckets, "band"))
    wanted = nodes.join(members.select("node").distinct(), "node")
    bags = cut(fetch_bags(docs, wanted))
    stars = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(verify(stars, bags, threshold))
    labels = components(links)
    # Buckets of two are decided by their centre.
    labelled = members.where("n > 2").join(labels, "node", "left").select("band", "n", "node", F.coalesce("label", "node").alias("label"))
    open_bands = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
    sizes = labelled.where(F.col("n") > TILE).groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    mains = sizes.groupBy("band").agg(F.max(F.struct("size", "label")).alias("m")).select("band", F.col("m.label").alias("main"), F.col("m.size").alias("n_main"))
    more = cut(tile_links(labelled.join(open_bands.join(mains, "band", "left"), "band"), bags, threshold))
    labels = merged(labels, more)
    labelled = nodes.join(labels, "node", "left").select("digest", "node", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
    found = labelled.groupBy("label").agg(best.alias("best"), F.sum("n").alias("class_size"))
    by_digest = labelled.select("digest", "label").join(found, "label").select("digest", F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("kept_row"), "class_size")
    return rows.select("row", "doc_id", "text_key", "digest").join(by_digest, "digest").select(
        "row", "doc_id", "text_key", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("is_kept")
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one row of each near-duplicate class.

    Rows are found again by doc_id and a hash of the text. The dropped keys
    are the smaller side of a hash join, so the texts are not sorted.
    """
    found = cut(classes(docs.select("doc_id", "text"), threshold).select("doc_id", "text_key", "is_kept"))
    keys = found.groupBy("doc_id", "text_key").agg(F.bool_or("is_kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    doc_id, text_key = F.col(numbered["doc_id"]), F.xxhash64(F.coalesce(F.col(numbered["text"]).cast("string"), F.lit("")))
    dropped = keys.where("not kept").select("doc_id", "text_key").hint("shuffle_hash").alias("k")
    same = (text_key == F.col("k.text_key")) & doc_id.cast("long").eqNullSafe(F.col("k.doc_id"))
    out = docs.withColumnsRenamed(numbered).join(dropped, same, "left_anti")
    repeated = keys.where("kept and n > 1").select("doc_id", "text_key")
    if repeated.limit(1).count():  # rows that are equal in id and text: one of them stays
        out = out.withColumn("_text_key", text_key).dropDuplicates([numbered["doc_id"], "_text_key"])
    return out.select(*[F.col(v).alias(c) for c, v in numbered.items()])
