"""Rules applied to events: filtering, extraction, tags, routes, redaction, statistics.

Every rule is a column over the original row, so all rules of a file run in
one projection and Catalyst sees them at once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import glob_to_regex
from logloom.plans.rules import actions, compiles, enabled, field_column, gated, guarded, java_groups, regex_or_contains, sections

# Rule targets and the columns they write; time, level, searchable text and id are never overwritten.
TARGETS = {
    "source": "provider", "provider": "provider", "taskname": "task_name", "opcode": "op_code", "machinename": "machine_name", "username": "username",
    "processid": "process_id", "threadid": "thread_id", "eventid": "event_id", "recordid": "record_id", "activityid": "activity_id",
    "relatedactivityid": "related_activity_id", "providerguid": "provider_guid", "keywords": "keywords", "channel": "channel", "processname": "process_name",
    "resultsource": "source",
}
#: Columns whose text a redaction rewrites, besides the values of ``fields``.
REDACTED = ["message", "searchable", "provider", "task_name", "username", "machine_name", "op_code"]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def rules_filter_view(df: DataFrame, rules: dict, field: str = "searchable") -> DataFrame:
    """Viewer's rule filter: no exclude rule matches and, if there are include rules, one of them does."""
    excluded, included = [], []
    for s in rules.get("sections", []):
        for r in enabled(s):
            if not r.get("match"):
                continue
            for a in actions(r, "include", "exclude"):
                hit = regex_or_contains(F.col(field), r["match"])
                if r.get("unmatch"):
                    hit = hit & ~regex_or_contains(F.col(field), r["unmatch"])
                (excluded if a["type"].lower() == "exclude" else included).append(hit)
    keep = ~_any(excluded)
    return df.where(keep & _any(included) if included else keep)


def rules_filter_pipeline(df: DataFrame, rules: dict) -> DataFrame:
    """Load pipeline's rule filter: each filter section starts as kept, its last include or exclude that matches decides.

    A row stays if some section keeps it and none drops it without tagging it.
    """
    own = sections(rules, "filter")
    if not own:
        return df
    kept, vetoed = [], []
    for s in own:
        keep, tagged = F.lit(True), F.lit(False)
        for r in enabled(s):
            hit = gated(s, r)
            for a in actions(r, "include", "exclude", "tag"):
                if a["type"].lower() == "tag":
                    tagged = tagged | hit
                else:
                    keep = F.when(hit, a["type"].lower() == "include").otherwise(keep)
        kept.append(keep)
        vetoed.append(~keep & ~tagged)
    return df.where(_any(kept) & ~_any(vetoed))


def rule_name(section: dict, rule: dict, no: int) -> str:
    return rule.get("name") or f"{section.get('name', 'section')} rule {no + 1}"


def _matches(rules: dict, purposes: set[str] | None) -> list[tuple[int, str, dict, Column]]:
    """(number, name, rule, gate) of every enabled rule."""
    out = []
    for s in rules.get("sections", []):
        if purposes is None or str(s.get("purpose", "")).lower() in purposes:
            for i, r in enumerate(enabled(s)):
                out.append((len(out), rule_name(s, r, i), r, gated(s, r)))
    return out


def rule_matches_long(df: DataFrame, rules: dict, purposes: set[str] | None = None) -> DataFrame:
    """row_id, rule_no, rule, action, value: one row for each action of each rule that a row matches."""
    hits = [
        F.when(gate, F.struct(F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), F.lit(str(a.get("type", "")).lower()).alias("action"), F.lit(str(a.get("tag") or a.get("value") or a.get("processor") or "")).alias("value")))
        for no, name, r, gate in _matches(rules, purposes)
        for a in actions(r)
    ]
    if not hits:
        return df.select("row_id", F.lit(0).alias("rule_no"), F.lit("").alias("rule"), F.lit("").alias("action"), F.lit("").alias("value")).limit(0)
    return df.select("row_id", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("row_id", "hit.*")


def rule_stats(df: DataFrame, rules: dict, purposes: set[str] | None = None) -> DataFrame:
    """rule_no, rule, matches: rows that each enabled rule matches, in one pass."""
    own = _matches(rules, purposes)
    if not own:
        return df.sparkSession.createDataFrame([], "rule_no int, rule string, matches long")
    counts = df.agg(*[F.count_if(gate).alias(f"r{no}") for no, _, _, gate in own])
    rows = F.array(*[F.struct(F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), F.col(f"r{no}").alias("matches")) for no, name, _, _ in own])
    return counts.select(F.inline(rows))


def _groups(pattern: str) -> list[str]:
    return re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)


def _group_value(column: Column, pattern: str, group: str) -> Column:
    """Text of a named group in the first match, '' without one: the number of its parenthesis is counted on the driver."""
    opened = [m for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?P?<(?![=!])([A-Za-z_]\w*)>", pattern) if m[0].startswith("(")]
    number = next(i for i, m in enumerate(opened, 1) if m[1] == group)
    return F.regexp_extract(column, java_groups(pattern), number)


def lookbehind_last(pattern: str) -> str:
    """A pattern that opens with a look-behind, with what follows it looked for first: a look-behind of many lengths is then tried at few places.

    Both look from one place, so their order makes no difference; a pattern with back-references stays as it is.
    """
    if not re.match(r"\(\?<[=!]", pattern) or re.search(r"\\[1-9kQE]|\(\?[^:=!<P]", pattern):
        return pattern
    depth, head = 0, ""
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()|]", pattern, re.DOTALL):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "|" and not depth:
            return pattern
        if not depth and m[0] == ")" and not head:
            head = pattern[: m.end()]
    rest = pattern[len(head) :]
    if rest[:1] in ("", "?", "*", "+", "{"):
        return pattern
    plain, at = [], 0
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P?<[A-Za-z_]\w*>|\((?!\?)|\|", rest, re.DOTALL):
        plain += [rest[at : m.start()], "(?:" if m[0].startswith("(") else m[0]]
        at = m.end()
    return f"(?={''.join(plain)}{rest[at:]}){head}{rest}"


def resolve_template(template: str, column: Column, pattern: str) -> Column:
    """A target's template: ``{group}`` stands for a named group's text; trimmed."""
    names = _groups(pattern)
    parts = []
    for text in re.split(r"(\{[A-Za-z_]\w*\})", template):
        name = text[1:-1]
        if text.startswith("{") and text.endswith("}") and name in names:
            parts.append(_group_value(column, pattern, name))
        elif text:
            parts.append(F.lit(text))
    return F.trim(F.concat(*parts)) if parts else F.lit("")


def strip_spans(text: Column, spans: Column) -> Column:
    """Text without the spans (array of start, end; 1-based, end exclusive), overlaps merged, white space collapsed."""
    ordered = F.array_sort(spans)
    state = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))

    def step(acc, s):
        before = F.substring(text, acc["at"], F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["done"], before).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    out = F.aggregate(ordered, state, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"], F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, F.trim(F.regexp_replace(out, r"\s{2,}", " "))).otherwise(text)


def extract(df: DataFrame, rules: dict, purposes: set[str] | None = None) -> DataFrame:
    """Extract actions of all rules: named groups to target columns, and matches stripped from the message.

    All rules read the original row; of several that write one column the last that has a value wins.
    Spans are stripped only where the rule reads the message itself.
    """
    gates: dict[str, Column] = {}
    found: dict[str, Column] = {}
    values: dict[str, Column] = {}
    spans: list[Column] = []
    for s in rules.get("sections", []):
        if purposes is not None and str(s.get("purpose", "")).lower() not in purposes:
            continue
        for r in enabled(s):
            for a in actions(r, "extract"):
                pattern = a.get("pattern") or r.get("match") or ""
                if not pattern or not compiles(java_groups(pattern)):
                    continue
                column = field_column(r.get("field"), "message")
                looked, on = lookbehind_last(pattern), f"_on{len(gates)}"
                gates[on] = gated(s, r, "message") & F.coalesce(column.rlike(java_groups(looked)), F.lit(False))
                for target, template in (a.get("set") or {}).items():
                    name = TARGETS.get(re.sub(r"[^a-z]", "", target.lower()))
                    if name:
                        got = f"_value{len(found)}"
                        found[got] = F.when(F.col(on), resolve_template(template, column, looked))
                        values[name] = F.when(F.col(got) != "", F.col(got)).otherwise(values.get(name, F.col(name)))
                if a.get("strip") and str(r.get("field") or "message").lower() in ("message", "msg"):
                    start = F.regexp_instr(column, F.lit(java_groups(looked)))
                    got = f"_span{len(found)}"
                    found[got] = F.when(F.col(on), F.struct(start.alias("start"), F.char_length(F.regexp_extract(column, java_groups(looked), 0)).alias("length")))
                    start, length = F.col(f"{got}.start"), F.col(f"{got}.length")
                    spans.append(F.when((start > 0) & (length > 0), F.struct(start.alias("start"), (start + length).alias("end"))))
    steps = [gates, found]
    if spans:
        steps.append({"_spans": F.array_compact(F.array(*spans))})
        values["message"] = strip_spans(F.col("message"), F.col("_spans"))
    if not values:
        return df
    # Each regular expression is in a projection of its own rows: it runs once, however often its result is used.
    out = reduce(lambda d, columns: d.withColumns(columns), steps, df).withColumns(values)
    return out.drop(*[c for columns in steps for c in columns])


def preview_extract(df: DataFrame, rules: dict, n: int = 20) -> DataFrame:
    """row_id, before, after and the target columns of a few rows."""
    sample = df.limit(n).withColumn("before", F.col("message"))
    done = extract(sample, rules)
    return done.select("row_id", "before", F.col("message").alias("after"), *sorted(set(TARGETS.values())))


def _collected(df: DataFrame, rules: dict, kind: str, key: str, column: str, purposes: set[str] | None) -> DataFrame:
    marks = [F.when(gate, F.lit(str(a.get(key) or a.get("value") or name))) for _, name, r, gate in _matches(rules, purposes) for a in actions(r, kind)]
    old = F.coalesce(F.col(column), F.array().cast("array<string>")) if column in df.columns else F.array().cast("array<string>")
    return df.withColumn(column, F.array_distinct(F.concat(old, F.array_compact(F.array(*marks)))) if marks else old)


def tag(df: DataFrame, rules: dict, purposes: set[str] | None = None) -> DataFrame:
    """Tags of matching rules added to ``tags``, each once, in the order of rules."""
    return _collected(df, rules, "tag", "tag", "tags", purposes)


def route(df: DataFrame, rules: dict, purposes: set[str] | None = None) -> DataFrame:
    """Processors that matching rules send a row to, in ``routes``."""
    return _collected(df, rules, "route", "processor", "routes", purposes)


def split_routes(df: DataFrame, processors: list[str]) -> dict[str, DataFrame]:
    return {p: df.where(F.array_contains("routes", p)) for p in processors}


def has_tag(name: str) -> Column:
    return F.exists("tags", lambda t: F.lower(t) == name.lower())


def tag_counts(df: DataFrame) -> DataFrame:
    """tag, n of all rows, most frequent first."""
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def redact_column(column: Column, rules: list[dict]) -> Column:
    """All matches of each redact rule replaced, rules in order, case ignored."""
    for r in rules:
        for a in actions(r, "redact"):
            pattern = "(?iu)" + java_groups(r["match"])
            if compiles(pattern):
                mark = (a.get("replacement") or "[REDACTED]").replace("\\", "\\\\").replace("$", "\\$")
                column = guarded(column, r["match"], F.regexp_replace(column, pattern, mark), column)
    return column


def redact(df: DataFrame, rules: dict) -> DataFrame:
    """Redact rules over all text columns and the payload's values."""
    own = [r for s in rules.get("sections", []) for r in enabled(s) if r.get("match") and actions(r, "redact")]
    if not own:
        return df
    out = {c: redact_column(F.col(c), own) for c in REDACTED if c in df.columns}
    if "fields" in df.columns:
        out["fields"] = F.transform_values("fields", lambda _, v: redact_column(v, own))
    return df.withColumns(out)


def enrich(df: DataFrame, rules: dict) -> DataFrame:
    """Enrichment sections: tags and routes first (they gate on the original row), then extraction."""
    return extract(route(tag(df, rules, {"enrichment"}), rules, {"enrichment"}), rules, {"enrichment"})


def auto_rules(df: DataFrame, entries: list[dict], build: int | None = None) -> DataFrame:
    """no, rule_file of the auto-rule entries that fit what was loaded, each file once.

    An entry has always, or some of extensions, sourceTypes, pathGlobs, providers (lists, any of which
    must be there) and minBuild, maxBuild; all given criteria must hold. Entries are aggregates
    over the distinct (source, provider) pairs, so there is no join.
    """
    from logloom.sources.folder import source_type

    if not entries:
        return df.sparkSession.createDataFrame([], "no int, rule_file string")
    files = df.select("source", "provider").distinct()
    low = lambda names: [str(x).lower() for x in names]
    tests = []
    for e in entries:
        seen = []
        if e.get("extensions"):
            seen.append(_any([F.lower("source").endswith("." + x.lstrip(".")) for x in low(e["extensions"])]))
        if e.get("sourceTypes"):
            seen.append(F.lower(source_type(F.col("source"))).isin(low(e["sourceTypes"])))
        if e.get("pathGlobs"):
            seen.append(_any([F.col("source").rlike(glob_to_regex(g)) for g in e["pathGlobs"]]))
        if e.get("providers"):
            seen.append(F.lower("provider").isin(low(e["providers"])))
        least, most = e.get("minBuild"), e.get("maxBuild")
        ranged = least is not None or most is not None
        fits = build is not None and (least is None or least <= build) and (most is None or build <= most) if ranged else True
        test = reduce(lambda a, b: a & b, [F.coalesce(F.bool_or(x), F.lit(False)) for x in seen], F.lit(bool(fits)))
        tests.append(F.lit(True) if e.get("always") else test if seen or ranged else F.lit(False))
    # One count makes the aggregate have a row even if no test looks at the files.
    hits = files.agg(F.count(F.lit(1)), *[t.alias(f"e{i}") for i, t in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(e["ruleFile"]).alias("rule_file"), F.col(f"e{i}").alias("fits")) for i, e in enumerate(entries)])
    return hits.select(F.inline(rows)).where("fits").groupBy("rule_file").agg(F.min("no").alias("no")).select("no", "rule_file").orderBy("no")


def collapse_unformatted(df: DataFrame) -> DataFrame:
    """Rows whose message could not be decoded, one per provider GUID with a count."""
    guid = F.regexp_extract("message", r"\b([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\b", 1)
    return (
        df.select(F.lower(guid).alias("guid"), "row_id").where("guid != ''").groupBy("guid").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
        .withColumn("message", F.concat(F.lit("Undecoded events of "), "guid", F.lit(": "), F.col("n").cast("string")))
    )


def quick_rule(df: DataFrame, pattern: str, group: int, target: str, strip: bool = False) -> DataFrame:
    """One group of the message's first match into a column where it is not empty; the match may be cut out."""
    value = F.regexp_extract("message", pattern, group)
    start, whole = F.regexp_instr("message", F.lit(pattern)), F.regexp_extract("message", pattern, 0)
    out = {target: F.when(value != "", value).otherwise(F.col(target))} if target else {}
    if strip:
        cut = F.overlay("message", F.lit(""), start, F.char_length(whole))
        out["message"] = F.when((start > 0) & (whole != ""), F.trim(F.regexp_replace(cut, r"\s{2,}", " "))).otherwise(F.col("message"))
    return df.withColumns(out)


def first_rule(df: DataFrame, rules: dict) -> DataFrame:
    """row_id, rule of the first rule that a row matches."""
    own = _matches(rules, None)
    name = F.coalesce(*[F.when(gate, F.lit(n)) for _, n, _, gate in own]) if own else F.lit(None).cast("string")
    return df.select("row_id", name.alias("rule")).where("rule is not null")
