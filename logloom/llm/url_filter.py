"""URL filter by a Bloom filter cascade: exact membership without joins.

The universe of keys is known: the distinct hosts of the corpus. Level 1 is a
Bloom filter of the listed keys; keys of the universe that pass it though they are
not listed are its false positives, and level 2 is a Bloom filter of these;
listed keys that pass level 2 go into level 3, and so on, until a level has
no false positives. The first level that a key does not pass tells what it
is: refused by an odd level, not listed; by an even one, listed. Over the
universe the answer is exact, and each level is a small array of 64-bit
words in the plan, so pages are judged within their scan.

Everything is DataFrame functions. The size of every level is known before it
is built (``BITS_PER_KEY`` bits for each of its counted keys). The universe is
dealt by a hash of the key into shards of about ``SHARD_KEYS`` filter keys, each with a cascade
of its own: the plan never holds more than one shard's levels. A list of one shard is
judged in one pass. For more, hosts, paths and rules are taken once and dealt by shard into the
shared folder, and each shard's pages are judged from there: two passes for a list of any length, and no join.

Defined results: a null url or one without ``://`` has empty host and path,
no rule, and is allowed; repeated rows give repeated results; an empty list
allows all that no rule blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import cut
from logloom.plans.durable import scratch

#: Bits and hash functions per key of a level.
BITS_PER_KEY, HASHES = 10, 5
#: Keys of a shard's levels together: 5 MB of words at 10 bits a key.
SHARD_KEYS = 4_000_000
#: Share of the keys beside a level that pass it, at 10 bits and 5 hashes a key (rounded up).
FALSE_SHARE = 0.02
#: After so many levels the few keys left are compared by value.
LAST_LEVEL, LAST_KEYS = 24, 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains if the path starts with the
    rule's; longest is by the rule's text, ties go to the first in the list.
    """
    chosen_text, chosen_verdict = None, None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen_text = F.when(fits, r.text) if chosen_text is None else chosen_text.when(fits, r.text)
        chosen_verdict = F.when(fits, r.verdict) if chosen_verdict is None else chosen_verdict.when(fits, r.verdict)
    if chosen_text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return chosen_text, chosen_verdict


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    """Place of the i-th bit of a key: double hashing on two seeded 64-bit hashes."""
    one, two = (F.xxhash64(F.lit(2 * level + half), key).bitwiseAND(F.lit(0x7FFFFFFF)) for half in (0, 1))
    return F.pmod(one + F.lit(i) * (two + 1), F.lit(bits).cast("long"))


@dataclass
class Level:
    bits: int
    words: list[int]

    def passes(self, key: Column, no: int) -> Column:
        # One text that the optimizer folds to one array literal, not a tree of literals.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = None
        for i in range(HASHES):
            place = _bit(key, no, i, self.bits)
            word = F.element_at(words, (F.shiftrightunsigned(place, 6) + 1).cast("int"))
            one = F.expr("1L")
            hit = F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(word) != 0
            out = hit if out is None else out & hit
        return out


@dataclass
class Cascade:
    """Levels, and the keys left over after the last one (few, compared by value)."""

    levels: list[Level] = field(default_factory=list)
    rest: list[str] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe."""
        out = key.isin(self.rest) if self.rest else F.lit(len(self.levels) % 2 == 1)
        for no in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[no].passes(key, no), out).otherwise(F.lit(no % 2 == 1))
        return out


def _level(keys: DataFrame, n: int, no: int) -> Level:
    """Bloom filter of n keys: words are made by a grouped bit_or, one row a word."""
    bits = -(-max(64, n * BITS_PER_KEY) // 64) * 64
    places = keys.select(F.explode(F.array(*[_bit(F.col("key"), no, i, bits) for i in range(HASHES)])).alias("place"))
    words = (
        places.groupBy(F.shiftrightunsigned("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
        .collect()  # bits / 64 rows at most
    )
    out = [0] * (bits // 64)
    for r in words:
        out[r["word"]] = r["bits"]
    return Level(bits, out)


def build(universe: DataFrame) -> Cascade:
    """The cascade of ``universe`` (distinct key, listed)."""
    keys = cut(universe.select("key", "listed"))
    cascade, wanted = Cascade(), True
    while True:
        held, others = keys.where(F.col("listed") == wanted), keys.where(F.col("listed") != wanted)
        n = held.count()
        no = len(cascade.levels)
        if wanted and 0 < n <= LAST_KEYS and no >= LAST_LEVEL:
            cascade.rest = [r["key"] for r in held.collect()]
            return cascade
        if not n:
            # Nothing of this side is left: whatever passed all levels so far is of the other side.
            return cascade
        level = _level(held, n, no)
        cascade.levels.append(level)
        false = others.where(level.passes(F.col("key"), no))
        keys = cut(held.unionByName(false))
        wanted = not wanted


def judge(pages: DataFrame, rules: list[Rule], listed: Column, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed per row of ``pages`` (page_id, url).

    ``listed`` is an aggregate over the pages of a host that tells whether
    the host is on the list; rules come first, the list decides the rest.
    """
    spark = pages.sparkSession
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    universe = cut(pages.groupBy(host_of(F.col("url")).alias("_key")).agg(listed.alias("_listed")).select(F.col("_key").alias("key"), F.coalesce("_listed", F.lit(False)).alias("listed")))
    size = universe.agg(F.count_if("listed").alias("held"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-int(size["held"] + FALSE_SHARE * size["n"]) // shard_keys))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    def judged(rows: DataFrame, cascade: Cascade) -> DataFrame:
        return rows.withColumn("listed", cascade.contains(F.col("host"))).select(
            "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"
        )

    if shards == 1:
        return judged(ruled, build(universe))
    # Pages and keys are dealt once; a shard's step reads its own folder of each. Spark splits the shard of a hot host.
    own = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))
    path = scratch(spark, "url_filter")
    for name, rows, key in (("pages", ruled, "host"), ("keys", universe, "key")):
        rows.withColumn("shard", own(F.col(key))).hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{path}/{name}")
    dealt = spark.read.schema(ruled.schema.add("shard", "long")).parquet(f"{path}/pages")
    keys = spark.read.schema(universe.schema.add("shard", "long")).parquet(f"{path}/keys")
    for i in range(shards):
        judged(dealt.where(F.col("shard") == i), build(keys.where(F.col("shard") == i))).write.parquet(f"{path}/judged/shard={i}")
    return spark.read.parquet(f"{path}/judged").drop("shard")
