"""Secret scan with corpus-wide ownership frequency.

A pattern tells what looks like a secret, not whether it is one: sample keys
of manuals look alike and are copied everywhere. So every candidate value is
hashed, and the hashes are aggregated over the whole corpus by distinct
repositories and owners. A value that many owners hold is a widely copied
example; one that stays with a few owners looks live.

Candidates are the three base kinds (assign, access, hex) and kinds of this
operator's own: well-known token shapes, private-key blocks, JSON web tokens
and credentials in URLs. Short values and those with few distinct
characters are candidates of no own kind.

The aggregation runs in two steps with map-side partial sums: (hash, owner)
counts repositories once each, then the hash counts owners. A value copied
into a third of all rows is a few partial rows per task. Verdicts return to
the candidates in a sort-merge join, whose hot hashes AQE splits.

Defined results: null or empty text has no spans; null owners and
repositories count as one owner or repository named ''; repeated rows of one
repository count once for the verdict; a value is an example from
``example_owners`` distinct owners on. Places are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map, cut

#: Distinct owners from which on a value counts as a widely copied example.
EXAMPLE_OWNERS = 4

#: Base kinds in the order of ties; the last element tells which matches stand.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m.group(2)) >= 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16, 0),
    ("hex", re.compile(r"[0-9a-f]{32,}"), lambda m: True, 0),
]
#: Kinds of this operator's own, after the base kinds: publicly documented token shapes; the group of the span and of the value, its least length and least number of distinct characters.
#: A web token is looked for once in each run of its characters, at the run's start: from every ``eyJ`` in a long run it would be read to the run's end again.
OWN = [
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]{8,}+){2})[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2})"), 1, 1, 16, 8),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,40}PRIVATE KEY-----"), 0, 0, 16, 8),
    ("prefixed", re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|ASIA)[A-Za-z0-9_-]{16,}"), 0, 0, 16, 8),
    ("url", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{8,128})@"), 0, 1, 8, 5),
    ("bearer", re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)"), 0, 1, 16, 8),
]
KINDS = [k for k, *_ in BASE] + [k for k, *_ in OWN]
#: What any own kind needs somewhere in the text.
_HINT = re.compile(r"eyJ|PRIVATE KEY|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_|ASIA|://|[Bb]earer")


def spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of all candidates, by start, then kind."""
    if not text:
        return []
    found = [
        (m.start(), no, m.end(), m.group(group))
        for no, (_, pattern, stands, group) in enumerate(BASE)
        for m in pattern.finditer(text)
        if stands(m)
    ]
    if _HINT.search(text):
        for no, (_, pattern, whole, group, least, distinct) in enumerate(OWN, len(BASE)):
            for m in pattern.finditer(text):
                value = m.group(group)
                if len(value) >= least and len(set(value)) >= distinct:
                    found.append((m.start(whole), no, m.end(whole), value))
    return sorted(found, key=lambda x: x[:3])


def joined(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[no]}:{start}:{end}" for start, no, end, _ in found)


def value_hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` (text and the ``keep`` columns): counts, base digest, spans and the candidates.

    candidates: array of (hash, kind, start, end) in the order of spans.
    """
    keep = keep or []
    kinds = dict(docs.dtypes)
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    schema = ", ".join(
        [*(f"_keep{i} {kinds[c]}" for i, c in enumerate(keep)), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, candidates array<struct<hash: binary, kind: string, start: int, end: int>>"]
    )
    kind = pa.list_(pa.struct([("hash", pa.binary()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            counts, digests, all_spans, candidates = ([], [], []), [], [], []
            for text in b.column("text").to_pylist():
                found = spans(text)
                base = [x for x in found if x[1] < len(BASE)]
                for no in range(len(BASE)):
                    counts[no].append(sum(x[1] == no for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(found))
                candidates.append([{"hash": value_hash(v), "kind": KINDS[no], "start": s, "end": e} for s, no, e, v in found])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_keep{i}") for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(candidates, kind)],
                names=[*(f"_keep{i}" for i in range(len(keep))), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"],
            )

    out = arrow_map(rows, run, schema)
    return out.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every hash; ``candidates`` has hash, owner, repo.

    A repository is named within its owner.
    """
    per_repo = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def secrets(docs: DataFrame, doc_id: Column, repo: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The scan of every row with the ownership verdict of its candidates.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, n_owners_max, and ``row``, a key of the input row, and
    ``live``: (start, end) of the spans that look live.
    """
    empty = F.lit("")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(repo.cast("string"), empty).alias("repo"), F.coalesce(owner.cast("string"), empty).alias("owner"), F.col("text").alias("text"))
    scanned = cut(scan(rows, ["doc_id", "repo", "owner"]).withColumn("row", F.monotonically_increasing_id()))
    single = (
        scanned.where(F.size("candidates") > 0)
        .select("row", "repo", "owner", F.explode("candidates").alias("c"))
        .select("row", "repo", "owner", "c.hash", "c.start", "c.end")
    )
    owned = ownership(single.select("hash", "owner", "repo"))
    example = F.col("n_owners") >= example_owners
    verdicts = (
        single.select("row", "hash", "start", "end").join(owned, "hash")
        .groupBy("row")
        .agg(
            F.count_if(~example).alias("n_live"), F.count_if(example).alias("n_example"), F.max("n_owners").alias("n_owners_max"),
            F.array_sort(F.collect_list(F.when(~example, F.struct("start", "end")))).alias("live"),
        )
    )
    zero = F.lit(0).cast("long")
    return scanned.drop("candidates", "repo", "owner").join(verdicts, "row", "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("n_live", "n_example", "n_owners_max")}
    )


#: What stands in place of a redacted secret.
REDACTED = "[redacted]"


def redact(docs: DataFrame, owner: str, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs``, all rows and columns, with live-looking secrets replaced; n_chars follows where it is a column.

    Each row's doc_id is its repository. Spans go back to their rows by
    doc_id and a hash of the text; overlapping spans become one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key")).alias("doc"), F.col("doc_id").alias("repo"), F.col(owner).alias("owner"), text.alias("text"))
    found = secrets(keyed, F.col("doc"), F.col("repo"), F.col("owner"), example_owners).where(F.size("live") > 0)
    live = found.groupBy(F.col("doc_id.id").alias("_id"), F.col("doc_id.key").alias("_key")).agg(F.first("live").alias("_live"))
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(numbered["text"])
    own_key = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    joined = docs.withColumnsRenamed(numbered).withColumn("_own_key", own_key).join(live, (F.col("_own_key") == F.col("_key")) & F.col(numbered["doc_id"]).cast("long").eqNullSafe(F.col("_id")), "left")
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.concat(acc["done"], before, F.lit(REDACTED)).alias("done"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at")))

    clean = F.aggregate("_live", state, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    out = joined.withColumn("_new", F.when(F.col("_live").isNull(), text).otherwise(clean))
    kinds = dict(docs.dtypes)
    return out.select(
        *[
            F.col("_new").alias(c) if c == "text"
            else F.when(F.col("_live").isNull(), F.col(v)).otherwise(F.char_length("_new").cast(kinds[c])).alias(c) if c == "n_chars"
            else F.col(v).alias(c)
            for c, v in numbered.items()
        ]
    )
