"""Document fingerprints by Order MinHash, in DataFrame functions only.

The k-mers of a text are numbered by occurrence, so the n-th copy of a k-mer is
an element of its own. Each element has a hash: that of the k-mer for the
first occurrence, that of (k-mer, number) for copies. The hash puts the element
into one of BINS bins; in each bin the TUPLE elements with the smallest hashes are
selected, put back into text order, and hashed as a tuple. Equal tuples need
the same k-mers in the same order, so the share of equal bins falls with the
edit distance and not just with the set of k-mers.

All k-mers of every text are elements, whatever its length. An element is one
long of bin, rank and place, so one primitive sort of a text's longs brings the
k-mers of a bin together, smallest first, copies side by side: the first
elements of the bins are found by binary search, and only copies get a second hash.

Defined results: a null text counts as empty; texts shorter than K have one
element, the text itself; the empty text has an empty fingerprint, like only
to another empty one. Rows are ordered by doc_id descending, nulls last; rows of
one doc_id by a hash of the text; the last row's next is the first. A
single row is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a k-mer, bins, elements of a bin's tuple.
K, BINS, TUPLE = 8, 64, 2

#: An element's long: bin, rank in the bin, place in the text.
_BIN_BITS, _RANK_BITS, _POS_BITS = 6, 28, 30
_LONGEST = 30  # bits of the number of k-mers of a text


def _same_kmer(a: Column, b: Column) -> Column:
    return F.shiftright(a.bitwiseXOR(b), _POS_BITS) == 0


def _lower_bound(run: Column, steps: Column, key: Column) -> Column:
    """Number of elements of the sorted ``run`` below ``key``, by binary search."""
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(run, lo + s - 1) < key, lo + s).otherwise(lo))


def packed_kmers(text: Column, first: Column | None = None) -> Column:
    """Hash and place of every k-mer in one long each; ``first`` is the place of the text's first character, if it is the rest of another."""
    n, alone = F.char_length(text), F.lit(True) if first is None else first == 0
    kmers = F.when(n >= K, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))).when((n > 0) & alone, F.array(text)).otherwise(F.array().cast("array<string>"))
    place = lambda i: (i if first is None else i + first).cast("long")
    return F.transform(kmers, lambda x, i: F.shiftleft(F.xxhash64(x), _POS_BITS).bitwiseOR(place(i)))


def with_fingerprint(df: DataFrame, packed: Column, out: str) -> DataFrame:
    """Adds ``out``, array<int>, of a text's ``packed_kmers``: bin number and tuple hash of each bin that has elements, by bin."""
    at, rank = (1 << _POS_BITS) - 1, (1 << _RANK_BITS) - 1
    c = {x: f"_{out}_{x}" for x in ("run", "again", "heads", "steps", "lows", "sel", "ord")}
    col = lambda x: F.col(c[x])
    none = F.array().cast("array<int>")

    # Sorted, bins are side by side, and copies of a k-mer in text order.
    df = df.withColumn(c["run"], F.sort_array(packed))

    # Copies, and where the copies of each k-mer begin; the n-th copy is element (k-mer, n).
    df = df.withColumn(c["again"], F.filter(c["run"], lambda v, j: _same_kmer(v, F.get(col("run"), j - 1))))
    many = F.size(c["again"])
    places = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(none)
    goes_on = lambda j: (j > 0) & _same_kmer(F.get(col("again"), j), F.get(col("again"), j - 1))
    df = df.withColumn(c["heads"], F.filter(places, lambda j: ~goes_on(j)))
    length = F.size(c["run"])
    halves = F.array(*[F.lit(1 << b) for b in range(_LONGEST - 1, -1, -1)])
    bits = F.char_length(F.bin(length.cast("long")))
    df = df.withColumn(c["steps"], F.slice(halves, -bits, bits))
    copy = lambda v, number: F.shiftleft(F.xxhash64(F.shiftright(v, _POS_BITS), number), _POS_BITS).bitwiseOR(v.bitwiseAND(F.lit(at)))
    until = lambda i: F.coalesce(F.get(col("heads"), i + 1), many)
    each = lambda s, i: F.transform(F.sequence(s, until(i) - 1), lambda j: copy(F.get(col("again"), j), j - s + 1))
    numbered = lambda s, i: F.when(until(i) - s == 1, F.array(copy(F.get(col("again"), s), F.lit(1)))).otherwise(each(s, i))
    copies = F.flatten(F.transform(c["heads"], numbered))

    # First occurrences: in sorted order the smallest of a bin, and the next of another k-mer.
    bounds = F.array(*[F.lit((b - BINS // 2) << (64 - _BIN_BITS)) for b in range(BINS)])
    df = df.withColumn(c["lows"], F.array_distinct(F.transform(bounds, lambda key: _lower_bound(col("run"), col("steps"), key))))
    beyond = lambda v: F.shiftleft(F.shiftright(v, _POS_BITS) + 1, _POS_BITS)
    second = lambda i: F.when(
        _same_kmer(F.get(col("run"), i), F.get(col("run"), i + 1)), _lower_bound(col("run"), col("steps"), beyond(F.get(col("run"), i)))
    ).otherwise(i + 1)
    firsts = F.flatten(F.transform(c["lows"], lambda i: F.array(F.get(col("run"), i), F.get(col("run"), second(i)))))
    df = df.withColumn(c["sel"], F.sort_array(F.concat(F.array_distinct(F.array_compact(firsts)), copies)))
    apart = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), 64 - _BIN_BITS) != 0
    chosen = F.filter(c["sel"], lambda v, j: (j < TUPLE) | apart(F.get(col("sel"), j - TUPLE), v))

    # Back to text order within each bin: bin, place, rank.
    top = F.lit(-(1 << (64 - _BIN_BITS)))
    in_order = F.transform(
        chosen,
        lambda v: v.bitwiseAND(top)
        .bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(at)), _RANK_BITS))
        .bitwiseOR(F.shiftrightunsigned(v, _POS_BITS).bitwiseAND(F.lit(rank))),
    )
    df = df.withColumn(c["ord"], F.sort_array(in_order))
    bin_of = lambda v: F.shiftright(v, 64 - _BIN_BITS) + BINS // 2
    part = lambda j, v: F.when(~apart(F.get(col("ord"), j), v), F.get(col("ord"), j).bitwiseAND(F.lit(rank)))

    def signature(v: Column, j: Column) -> Column:
        starts = (j < 1) | apart(F.get(col("ord"), j - 1), v)
        tuple_hash = F.xxhash64(*[part(j + i, v) for i in range(TUPLE)])
        code = F.shiftleft(bin_of(v), 32 - _BIN_BITS).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << (32 - _BIN_BITS)) - 1)))
        return F.when(starts, code - F.lit(1 << 31)).cast("int")

    df = df.withColumn(out, F.array_compact(F.transform(c["ord"], signature)))
    return df.drop(*c.values())


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits a bin: six bits of its number, then 26 of its tuple's hash."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v.cast("long") + F.lit(1 << 31)), 8, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    """Estimated share of text that two fingerprints have in common, 0 to 1.

    A bin is equal if its TUPLE elements are among those that both texts
    have, so the share p of equal bins is about J ** TUPLE for texts whose
    elements have Jaccard likeness J; 2 J / (1 + J) is the share in common.
    """
    most = F.greatest(F.size(one), F.size(two))
    j = F.pow(F.size(F.array_intersect(one, two)) / most, F.lit(1.0 / TUPLE))
    return F.when(most == 0, 1.0).otherwise(2 * j / (1 + j))


def _constants(values: list[int]) -> Column:
    """An array of longs as one text that the optimizer folds to a literal, not a tree of literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def dealt_with_next(df: DataFrame, tie: Column) -> tuple[DataFrame, W]:
    """(rows with ``_slot``, ``_copy`` and ``_tie``, window) for leads over the order of descending doc_id (nulls last), then ascending ``tie``, a long hash; the last row's next is the first.

    Rows are dealt into ranges of this order: ranges of doc_id, and for a
    doc_id (or null) that many rows share, ranges of the hash. Each
    range also gets a copy of the first row of the range after it, so that a
    window within the range finds every next row; copies are to be dropped afterwards. One shuffle, no window over all rows,
    and on the driver no more than a few numbers per range.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select("doc_id").where("doc_id is not null")
    found = [int(b) for b in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)] if ranges > 1 else []
    bounds = sorted(set(found))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    # Range i holds the ids above bound i - 1 up to bound i; a bound that is several quantiles is cut by the hash.
    parts = [found.count(b) if found.count(b) > 1 else 0 for b in bounds] + [0]
    bases, slot = [0] * len(parts), 0
    for i in range(len(parts) - 1, -1, -1):
        bases[i] = slot
        slot += parts[i] + 1
    null_parts = 1 + int(ranges * size["nulls"] / max(1, size["n"]))
    steps = F.array(*[F.lit(1 << b) for b in range(max(1, len(bounds)).bit_length(), -1, -1)])
    limits = _constants(bounds)
    below = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(limits, lo + s - 1) < F.col("doc_id")), lo + s).otherwise(lo))
    by_hash = lambda n: F.least(F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * n), n - 1).cast("int")
    n_parts = F.get(_constants(parts), F.col("_range"))
    sub = F.when(n_parts == 0, 0).when(F.col("doc_id") == F.get(limits, F.col("_range")), by_hash(n_parts)).otherwise(n_parts)
    place = F.when(F.col("doc_id").isNull(), slot + by_hash(F.lit(null_parts))).otherwise(F.get(_constants(bases), F.col("_range")) + sub).cast("int")
    dealt = df.withColumn("_tie", tie).withColumn("_range", below).withColumn("_slot", place).drop("_range")
    firsts = (
        dealt.select("_slot", "doc_id", F.bitwise_not("_tie").alias("tie"))
        .groupBy("_slot").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
        .select("_slot", "first.doc_id", "first.tie").orderBy("_slot").collect()
    )
    order = W.partitionBy("_slot").orderBy("_copy", F.desc_nulls_last("doc_id"), "_tie")
    if not firsts:
        return dealt.withColumn("_copy", F.lit(False)), order
    # The first row of each range goes to the range before it; the first of all to the last range.
    last = firsts[-1]["_slot"]
    first_id, first_tie, before = [0] * (last + 1), [0] * (last + 1), [0] * (last + 1)
    for i, r in enumerate(firsts):
        first_id[r["_slot"]], first_tie[r["_slot"]], before[r["_slot"]] = r["doc_id"] or 0, ~r["tie"], firsts[i - 1]["_slot"]
    at = lambda values: F.get(_constants(values), F.col("_slot"))
    heads = dealt.where((F.col("_tie") == at(first_tie)) & (F.col("doc_id").isNull() | (F.col("doc_id") == at(first_id))))
    copies = heads.withColumn("_slot", at(before).cast("int"))
    return dealt.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True))), order


def with_next(df: DataFrame, columns: list[str], tie: Column) -> DataFrame:
    """Adds next_<column>: the column of the next row in the order of ``dealt_with_next``."""
    dealt, order = dealt_with_next(df, tie)
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return found.where(~F.col("_copy")).drop("_copy", "_slot", "_tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint columns of every row of ``docs`` (doc_id, text) and of its edited text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    dealt, order = dealt_with_next(rows, F.xxhash64("text"))
    near = dealt.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own = (F.col("n_chars") - half).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), own), F.substring(F.col("next_text"), F.lit(1), half))
    near = near.withColumns({"edited": edited, "kmers": packed_kmers(F.col("text"))}).withColumn("sha", F.sha2("edited", 256))
    # The edited text's k-mers are the text's own up to the edit, and those of the rest.
    kept = F.greatest(own - K + 1, F.lit(0))
    rest = packed_kmers(F.substring(F.col("edited"), kept + 1, F.lit(2**31 - 1)), kept)
    both = F.concat(F.slice("kmers", F.lit(1), kept), rest)
    near = near.select("doc_id", "n_chars", "sha", "kmers", both.alias("edited_kmers"), "_slot", "_copy", "_tie")
    done = with_fingerprint(with_fingerprint(near, F.col("kmers"), "fp").drop("kmers"), F.col("edited_kmers"), "edited_fp").drop("edited_kmers")
    done = done.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("_copy"))
    return done.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
