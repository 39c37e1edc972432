"""The registered queries of the corpus operators, with production parameters.

Each query applies its operator to the whole table and derives the columns
of its result contract; ``ORACLE`` has DuckDB SQL where SQL can express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import chunk_dedup, decontam, fingerprint, langid, license_scan, line_dedup, merkle, neardup, packing, periodic, secret_scan, toxicity, url_filter
from logloom.llm.common import doc_crc, table
from logloom.plans.durable import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing; fitted on rows whose crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    fold = doc_crc() % 5
    sample = langid.fit_sample(docs.where(fold != 0).select("doc_id", "text", "lang"))
    return langid.identify(docs, sample, held_out=fold == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) whose text holds the item within its edit budget."""
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; a document is the repository, its source the owner."""
    docs = documents(spark, sf_dir)
    found = secret_scan.secrets(docs, F.col("doc_id").cast("long"), F.col("doc_id"), F.col("source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_owners_max")


def tokenizer_path() -> str:
    """The production tokenizer's file; installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: 5-word shingles, weighted Jaccard 0.8 or more."""
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "is_kept")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document."""
    return license_scan.licenses(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the lexicon is learned from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(doc_crc() % 4 != 2)
    lexicon = toxicity.fit_lexicon(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score(docs, lexicon, held_out=doc_crc() % 4 == 2)


#: Rules of op9 (verdict, host, path); a host is on the list if it has one of the words, or if a quarter of its pages are thin (less html than this).
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
LISTED_HOSTS, THIN_PAGE = "spam|pills|bets|casino", 1500


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest rule, else membership in the list of hosts."""
    thin = 4 * F.count_if(F.char_length("html") < THIN_PAGE) >= F.count(F.lit(1))
    listed = F.bool_or(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)) | thin
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur more than once, across documents or within one, by content-defined chunks."""
    return chunk_dedup.repeated_passages(documents(spark, sf_dir))


#: What separates words, and op11's white space at the ends of a text.
SPACES = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; where h = crc32(doc_id) is a multiple of 10, the words from g % n on (g = h div 10) become copies of the first p of them, p = 1 + (n - a) div (3 + g % 8)."""
    h = doc_crc()
    planted = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    words = F.split(F.regexp_replace("text", rf"^{SPACES}|{SPACES}\z", ""), SPACES)
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(planted, words).alias("words"))
    n = F.size("words")
    found = found.withColumn("a", F.pmod(F.col("g"), n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    new = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return found.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(new).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, after runs are planted in a tenth of them."""
    found = periodic.scan(with_planted_runs(documents(spark, sf_dir)))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    out = line_dedup.dedup(documents(spark, sf_dir))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document in the tree of its language and of all languages; a third is tampered with."""
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, "lang", ["doc_id", "source", "lang", "n_chars", "text"], doc_crc() % 3 == 0).drop("grp", "slot")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def merkle_sql(levels: int = 7, group_levels: int = 2) -> str:
    """op13 as SQL, level by level: enough for 8 ** ``levels`` documents of a language and 8 ** ``group_levels`` languages."""
    az = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]
    part = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({v} AS VARCHAR))), ':', CAST({v} AS VARCHAR)) END"
    leaf = lambda text: f"sha256(concat({', '.join(part(c, text if c == 'text' else c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}))"
    bits = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda acc, b: {bits}), 4294967295)"
    steps = [
        f"docs AS (SELECT *, coalesce('+' || lang, '') AS grp, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f'translate(text, {az[0]!r}, {az[1]!r})')} ELSE {leaf('text')} END AS shown FROM documents)",
        "p0 AS (SELECT doc_id, grp, leaf, shown AS now, '' AS proof, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs)",
        "n0 AS (SELECT grp, i, leaf AS node FROM p0)",
    ]

    def level(nodes: str, proofs: str, k: int, tree: str, keep: str) -> list[str]:
        """Nodes and proofs one level up; a tree of one node stays as it is."""
        left, right = "array_to_string(s.nodes[:p.i % 8], '')", "array_to_string(s.nodes[p.i % 8 + 2:], '')"
        return [
            f"{nodes}s{k} AS (SELECT {tree}, i // 8 AS run, list(node ORDER BY i) AS nodes, any_value(many) AS many FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) > 1 AS many FROM {nodes}{k}) GROUP BY 1, 2)",
            f"{nodes}{k + 1} AS (SELECT {tree}, run AS i, CASE WHEN many THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {nodes}s{k})",
            f"{proofs}{k + 1} AS (SELECT {keep}, CASE WHEN s.many THEN sha256(concat({left}, p.now, {right})) ELSE p.now END AS now, CASE WHEN s.many THEN concat(p.proof, {left}, {right}) ELSE p.proof END AS proof,"
            f" p.i // 8 AS i FROM {proofs}{k} p JOIN {nodes}s{k} s ON s.{tree} = p.{tree} AND s.run = p.i // 8)",
        ]

    for k in range(levels):
        steps += level("n", "p", k, "grp", "p.doc_id, p.grp, p.leaf")
    steps += [
        f"g0 AS (SELECT 0 AS tree, grp, node, row_number() OVER (ORDER BY encode(grp)) - 1 AS i FROM n{levels})",
        f"q0 AS (SELECT p.doc_id, 0 AS tree, p.leaf, g.node AS subroot, p.now, p.proof, g.i FROM p{levels} p JOIN g0 g USING (grp))",
    ]
    for k in range(group_levels):
        steps += level("g", "q", k, "tree", "p.doc_id, p.tree, p.leaf, p.subroot")
    last = f"SELECT q.doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = node AS verified FROM q{group_levels} q, g{group_levels}"
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE: dict[str, str] = {
    "op13_merkle_manifest": merkle_sql(),
    "op12_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM d),
        k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        frequent AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
        SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN frequent f ON k.key = f.key GROUP BY k.row""",
    "op9_url_filter": f"""
        WITH parts AS (
            SELECT page_id, html,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        ruled AS (
            SELECT page_id, host, path,
                   regexp_matches(host, '{LISTED_HOSTS}')
                   OR 4 * count(*) FILTER (WHERE length(html) < {THIN_PAGE}) OVER (PARTITION BY host) >= count(*) OVER (PARTITION BY host) AS listed,
                   CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
                             THEN 'www.example.com/en/'
                        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
        FROM ruled""",
}
