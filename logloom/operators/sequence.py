"""Sequences: interactions between actors, collapsed runs, diagram elements and their markup.

Orders are by time, then row id. A sequence may hold a large part of all rows, so
what depends on the row before (``with_previous``) and running sums
(``running_sum``) are taken within ranges of the order; what crosses from one range to the
next is carried over by a table with one row for each sequence and range.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.text import contains_ci, mermaid_escape
from logloom.plans.rules import compiles, java_groups

ACTOR_LENGTH, LABEL_LENGTH, MAX_ARROWS = 40, 80, 200
#: Element types of diagram rules.
TYPES = ("message", "note", "activate", "deactivate", "divider", "delay", "group", "groupend")


def _shortened(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def actor(c: Column) -> Column:
    """Actor's name: signs that break markup become spaces, white space collapses, at most ACTOR_LENGTH; ``unknown`` if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd} ._/\-()#@]", " "), " +", " "))
    return F.when(clean == "", "unknown").otherwise(_shortened(clean, ACTOR_LENGTH))


def label(c: Column) -> Column:
    """Label on one line, without signs that end a statement, at most LABEL_LENGTH; ``(event)`` if nothing is left."""
    clean = F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\r\n;#", "  , "), " +", " "))
    return F.when(clean == "", "(event)").otherwise(_shortened(clean, LABEL_LENGTH))


def ranged(df: DataFrame, by: str, tie: str | None = None) -> DataFrame:
    """Adds ``_range``, an ascending number of about equally filled ranges of a time or number, NULL first.

    A value that many rows share, and NULL, are ranges of the number ``tie``, which orders rows of equal time.
    """
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.unix_micros(F.col(by).cast("timestamp")) if dict(df.dtypes)[by].startswith("timestamp") else F.col(by).cast("long")
    keyed = df.withColumn("_key", key)
    quantiles = lambda c: [int(x) for x in keyed.approxQuantile(c, [i / n for i in range(1, n)], 0.2 / n)]
    found = quantiles("_key")
    bounds, heavy = sorted(set(found)), sorted({x for x in found if found.count(x) > 1})
    ties = sorted(set(quantiles(tie))) if tie else []

    def below(values: list[int], c: str) -> Column:
        """Number of ``values`` below the column, by binary search."""
        if not values:
            return F.lit(0)
        array = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << b) for b in range(len(values).bit_length(), -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(values)) & (F.get(array, lo + s - 1) < F.col(c)), lo + s).otherwise(lo))

    width = len(ties) + 2
    shared = F.col("_key").isNull() | (F.col("_key").isin(heavy) if heavy else F.lit(False))
    # The rows of a heavy bound are the last of its range of values.
    sub = F.when(shared, below(ties, tie) + 1).otherwise(0) if tie else F.lit(0)
    whole = F.when(F.col("_key").isNull(), 0).otherwise(below(bounds, "_key") + 1)
    return keyed.withColumn("_range", whole * width + sub).drop("_key")


def with_previous(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev_<column>`` of the row before in the group's order. ``df`` has ``_range`` (see ``ranged``)."""
    inside = W.partitionBy(*group, "_range").orderBy(*order)
    near = df.withColumns({f"prev_{c}": F.lag(c).over(inside) for c in columns} | {"_head": F.row_number().over(inside) == 1})
    last = W.partitionBy(*group, "_range").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = df.withColumn("_no", F.row_number().over(last)).where("_no = 1").select(*group, "_range", *columns)
    # One row for each range of a group.
    carried = tails.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), *[F.lag(c).over(W.partitionBy(*group).orderBy("_range")).alias(f"_c{i}") for i, c in enumerate(columns)])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = near.join(carried, same, "left")
    out = joined.withColumns({f"prev_{c}": F.when(F.col("_head"), F.col(f"_c{i}")).otherwise(F.col(f"prev_{c}")) for i, c in enumerate(columns)})
    return out.select(*df.columns, *[f"prev_{c}" for c in columns])


def running_sum(df: DataFrame, group: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """Adds the sum of a column over the group's rows up to this one. ``df`` has ``_range``."""
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = df.withColumn(out, F.sum(column).over(inside))
    sums = df.groupBy(*group, "_range").agg(F.sum(column).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return near.join(offsets, same, "left").select(*df.columns, (F.col(out) + F.col("_before")).alias(out))


def interactions(df: DataFrame, actor_col: str, label_col: str, group: list[str], order: list[str] = ("log_time", "row_id")) -> DataFrame:
    """group, seq, kind, from_actor, to_actor, label, n: one row per run of equal (actor, label).

    The first of a sequence is a note, the others messages from the actor of
    the run before. Rows without an actor are left out.
    """
    order = list(order)
    rows = df.where(F.trim(F.coalesce(actor_col, F.lit(""))) != "").select(*group, *order, actor(F.col(actor_col)).alias("a"), label(F.col(label_col)).alias("l"))
    runs = collapse_runs(rows, ["a", "l"], group, order, carry=["a"])
    before = F.col("prev_a")
    return runs.select(*group, "seq", F.when(before.isNull(), "note").otherwise("message").alias("kind"), before.alias("from_actor"), F.col("a").alias("to_actor"), F.col("l").alias("label"), "n")


def collapse_runs(df: DataFrame, keys: list[str], group: list[str], order: list[str], carry: list[str] = ()) -> DataFrame:
    """Runs of consecutive rows with equal keys: group, seq (from 1), keys, n; for ``carry`` also prev_<key> of the run before."""
    from logloom.plans.durable import cut

    own = [k for k in keys if k not in group and k not in order]
    rows = ranged(df.select(*group, *order, *own, F.lit(1).alias("_one")), order[0], order[1] if order[1:] == ["row_id"] else None)
    near = with_previous(rows, group, order, [*own, "_one"])
    same = F.col("prev__one").isNotNull()
    for k in own:
        same = same & F.col(k).eqNullSafe(F.col(f"prev_{k}"))
    marked = near.withColumn("_new", F.when(same, 0).otherwise(1))
    numbered = running_sum(cut(marked), group, order, "_new", "seq")
    kept = [F.max(F.when(F.col("_new") == 1, F.col(f"prev_{k}"))).alias(f"prev_{k}") for k in carry]
    return numbered.groupBy(*group, "seq", *own).agg(F.count(F.lit(1)).alias("n"), *kept)


def actor_alias(df: DataFrame, actor_col: str, group: list[str], order: list[str] = ("log_time", "row_id")) -> DataFrame:
    """group, actor, alias: p0, p1, ... in the order of first appearance within the group."""
    at = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    first = df.groupBy(*group, actor(F.col(actor_col)).alias("actor")).agg(at.alias("at"))
    number = F.row_number().over(W.partitionBy(*group).orderBy("at", "actor")) - 1
    return first.select(*group, "actor", F.concat(F.lit("p"), number.cast("string")).alias("alias"))


def cap_sequence(sequence: DataFrame, group: list[str], cap: int = MAX_ARROWS) -> DataFrame:
    """The first ``cap`` elements of each sequence, and a last note that says how many events more there are."""
    rest = sequence.where(F.col("seq") > cap).groupBy(*group).agg(F.sum("n").alias("_rest"))
    kept = sequence.where(F.col("seq") <= cap + 1).join(rest, group, "left")
    more = F.concat(F.lit("… "), F.col("_rest").cast("string"), F.lit(" more events (truncated)"))
    last = F.col("seq") > cap
    return kept.select(
        *group, "seq", F.when(last, "note").otherwise(F.col("kind")).alias("kind"), F.when(~last, F.col("from_actor")).alias("from_actor"),
        F.when(last, F.col("from_actor")).otherwise(F.col("to_actor")).alias("to_actor"), F.when(last, more).otherwise(F.col("label")).alias("label"), F.when(last, 1).otherwise(F.col("n")).alias("n"),
    )


def _matches(content: Column, pattern: str, use_regex: bool | None) -> Column:
    if use_regex is False or (use_regex is None and not compiles(java_groups(pattern))):
        return contains_ci(content, pattern)
    return content.rlike("(?iu)" + java_groups(pattern)) if compiles(java_groups(pattern)) else F.lit(False)


def resolve_placeholders(text: str, content: Column, matched: str) -> Column:
    """A diagram text: ``{afterMatch}``, ``{afterMatch:untilSpace}``, ``{afterMatch:until:c}``, ``{beforeMatch}``, ``{extract:re}`` out of the row."""
    at = F.instr(content, matched) if matched else F.lit(1)
    after = F.when(at > 0, F.substring(content, at + len(matched), F.lit(2**31 - 1))).otherwise("")
    parts = []
    for p in re.split(r"(\{afterMatch(?::untilSpace|:until:.)?\}|\{beforeMatch\}|\{extract:[^}]+\})", text or ""):
        if p == "{afterMatch}":
            parts.append(after)
        elif p == "{afterMatch:untilSpace}":
            parts.append(F.substring_index(after, " ", 1))
        elif p.startswith("{afterMatch:until:"):
            parts.append(F.substring_index(after, p[-2], 1))
        elif p == "{beforeMatch}":
            parts.append(F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(""))
        elif p.startswith("{extract:"):
            inner = p[9:-1]
            groups = len(re.findall(r"(?<!\\)\((?!\?)", inner))
            parts.append(F.regexp_extract(content, inner, 1 if groups else 0) if compiles(inner) else F.lit(""))
        elif p:
            parts.append(F.lit(p))
    return F.coalesce(F.concat(*parts), F.lit("")) if parts else F.lit("")


def diagram_hits(df: DataFrame, definition: dict, content: str = "message", group: list[str] = ()) -> DataFrame:
    """group, row_id, log_time, rule_no, rule, type, from, to, text, arrow, position of every rule that a row matches."""
    hits = []
    text = F.coalesce(F.col(content), F.lit(""))
    for i, r in enumerate(definition.get("rules", [])):
        a = r.get("action") or {}
        gate = _matches(text, r.get("match", ""), r.get("useRegex"))
        if r.get("unmatch"):
            gate = gate & ~_matches(text, r["unmatch"], None)
        hits.append(
            F.when(
                gate,
                F.struct(
                    F.lit(i).alias("rule_no"), F.lit((r.get("name") or "").strip() or f"rule {i + 1}").alias("rule"), F.lit((a.get("type") or "").strip().lower()).alias("type"),
                    F.lit((a.get("from") or "").strip()).alias("from_id"), F.lit((a.get("to") or "").strip()).alias("to_id"), resolve_placeholders(a.get("text") or "", text, r.get("match", "")).alias("text"),
                    F.lit((a.get("arrowStyle") or "solid").lower()).alias("arrow"), F.lit((a.get("notePosition") or "over").lower()).alias("position"),
                ),
            )
        )
    if not hits:
        return df.limit(0).select(*group, "row_id", "log_time", F.lit(0).alias("rule_no"), *[F.lit("").alias(c) for c in ("rule", "type", "from_id", "to_id", "text", "arrow", "position")])
    return df.select(*group, "row_id", "log_time", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*group, "row_id", "log_time", "h.*")


def diagram_elements(df: DataFrame, definition: dict, content: str = "message", group: list[str] = ()) -> DataFrame:
    """The elements a diagram, or one for each group, shows. An activate needs a participant; a deactivate one that is active:
    whose activate or deactivate before it is an activate.
    """
    hits = diagram_hits(df, definition, content, group)
    switch = F.col("type").isin("activate", "deactivate")
    switches = with_previous(ranged(hits.where(switch & (F.col("from_id") != "")), "log_time", "row_id"), [*group, "from_id"], ["log_time", "row_id", "rule_no"], ["type"])
    shown = switches.where((F.col("type") == "activate") | (F.col("prev_type") == "activate"))
    return hits.where(~switch).unionByName(shown.select(hits.columns))


def diagram_usage(df: DataFrame, definition: dict, content: str = "message") -> DataFrame:
    """rule_no, rule, hits, of every rule that matched."""
    return diagram_hits(df, definition, content).groupBy("rule_no", "rule").agg(F.count(F.lit(1)).alias("hits")).orderBy("rule_no")


def diagram_rows(df: DataFrame, definition: dict, content: str = "message") -> DataFrame:
    """row_id, rule: rows that feed the diagram, with their first rule."""
    names = [(r.get("name") or "").strip() or f"rule {i + 1}" for i, r in enumerate(definition.get("rules", []))]
    first = diagram_hits(df, definition, content).groupBy("row_id").agg(F.min("rule_no").alias("rule_no"))
    return first.select("row_id", F.get(F.array(*map(F.lit, names)), F.col("rule_no")).alias("rule"))


def mermaid_line() -> Column:
    """Mermaid markup of an element."""
    text = mermaid_escape(F.col("text"))
    quoted = F.concat(F.lit(": '"), F.replace(text, F.lit("'"), F.lit("’")), F.lit("'"))
    arrow = F.when(F.col("arrow").isin("dashed", "dotted", "response"), "-->>").when(F.col("arrow") == "async", "-)").otherwise("->>")
    place = F.when(F.col("position").isin("left", "right"), F.concat(F.col("position"), F.lit(" of "))).otherwise("over ")
    line = (
        F.when(F.col("type") == "message", F.concat("from_id", arrow, "to_id", quoted))
        .when(F.col("type") == "note", F.concat(F.lit("note "), place, "from_id", quoted))
        .when(F.col("type").isin("activate", "deactivate"), F.concat("type", F.lit(" "), "from_id"))
        .when(F.col("type") == "divider", F.concat(F.lit("note over "), "from_id", quoted))
        .when(F.col("type") == "delay", F.concat(F.lit("note right of "), "from_id", quoted))
        .when(F.col("type") == "group", F.concat(F.lit("rect rgb(200, 200, 200)\n    note left of "), "from_id", quoted))
        .when(F.col("type") == "groupend", "end")
        .otherwise(F.concat(F.lit("%% unknown element type: "), "type"))
    )
    return F.concat(F.lit("    "), line)


def plantuml_line() -> Column:
    """PlantUML markup of an element."""
    arrow = F.when(F.col("arrow").isin("dashed", "response"), "-->").when(F.col("arrow") == "async", "->>").when(F.col("arrow") == "dotted", "..>").otherwise("->")
    place = F.when(F.col("position").isin("left", "right"), F.concat(F.col("position"), F.lit(" of "))).otherwise("over ")
    return (
        F.when(F.col("type") == "message", F.concat("from_id", F.lit(" "), arrow, F.lit(" "), "to_id", F.lit(" : "), "text"))
        .when(F.col("type") == "note", F.concat(F.lit("note "), place, "from_id", F.lit(" : "), "text"))
        .when(F.col("type").isin("activate", "deactivate"), F.concat("type", F.lit(" "), "from_id"))
        .when(F.col("type") == "divider", F.concat(F.lit("== "), "text", F.lit(" ==")))
        .when(F.col("type") == "delay", F.concat(F.lit("..."), "text", F.lit("...")))
        .when(F.col("type") == "group", F.concat(F.lit("group "), "text"))
        .when(F.col("type") == "groupend", "end")
        .otherwise(F.concat(F.lit("' unknown element type: "), "type"))
    )


def dedupe_elements(elements: DataFrame, group: list[str] = ()) -> DataFrame:
    """Equal elements once, in the order of their first appearance, texts ending in ×N; adds ``n`` and ``first_row``."""
    at = F.struct("log_time", "row_id", "rule_no")
    shape = [*group, "type", "from_id", "to_id", "text", "arrow", "position"]
    one = elements.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
    counted = F.when((F.col("n") > 1) & (F.col("text") != ""), F.concat("text", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("text"))
    return one.withColumn("text", counted).select("at.log_time", "at.row_id", "at.rule_no", *shape, "n")


#: Elements of a diagram at most where its definition sets no bound; tasks that first share a group's elements.
MOST_ELEMENTS, SHARES = 10_000, 16


def _diagram_frame(definition: dict, mermaid: bool, cap: int) -> tuple[str, str, str]:
    """Lines before the elements, the line in place of those beyond the bound, lines behind."""
    title, participants = definition.get("title"), definition.get("participants", [])
    head = ["sequenceDiagram"] + ([f"    title {title}"] if title else []) if mermaid else ["@startuml"] + ([f"title {title}"] if title else [])
    for p in participants:
        name, kind = p.get("displayName") or p["id"], str(p.get("type") or "participant").lower()
        if mermaid:
            shown = f'"{name}"' if re.search(r"[ .\-]", name) else name
            head.append(f"    {'actor' if kind == 'actor' else 'participant'} {p['id']}" + (f" as {shown}" if name != p["id"] else ""))
        else:
            known = kind if kind in ("actor", "database", "queue", "entity", "boundary", "control", "collections") else "participant"
            head.append(f'{known} "{name}" as {p["id"]}' if name != p["id"] else f"{known} {p['id']}")
    over, note = participants[0]["id"] if participants else "", f"diagram truncated at {cap} elements"
    more = f"    note over {over}: '{note}'" if mermaid else f"note over {over} : {note}"
    return "".join(f"{x}\n" for x in head), f"{more}\n", "" if mermaid else "@enduml\n"


def diagram_texts(df: DataFrame, definition: dict, group: list[str], syntax: str = "mermaid", content: str = "message") -> DataFrame:
    """group, elements (shown at most), markup: one diagram for each group that has elements, put together on executors.

    Of a group the first ``maxElements`` elements count (MOST_ELEMENTS if that is 0): each of SHARES tasks keeps so many
    of its share, so a group of any size is bounded before its lines meet.
    """
    elements = diagram_elements(df, definition, content, group)
    if definition.get("dedupe"):
        elements = dedupe_elements(elements, group)
    cap, mermaid = int(definition.get("maxElements") or 0) or MOST_ELEMENTS, syntax == "mermaid"
    order = ["log_time", "row_id", "rule_no"]
    lines = elements.select(*group, *order, (mermaid_line() if mermaid else plantuml_line()).alias("line")).withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(SHARES)))
    for keys in ([*group, "_share"], group):
        lines = lines.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_no") <= cap + 1)
    shown = F.array_sort(F.collect_list(F.when(F.col("_no") <= cap, F.struct("_no", "line"))))
    head, more, tail = _diagram_frame(definition, mermaid, cap)
    out = lines.groupBy(*group).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("elements"), shown.alias("shown"), F.count_if(F.col("_no") > cap).alias("beyond"))
    text = F.array_join(F.transform("shown", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return out.select(*group, "elements", F.concat(F.lit(head), text, F.when(F.col("beyond") > 0, more).otherwise(""), F.lit(tail)).alias("markup"))


def diagram_text(df: DataFrame, definition: dict, syntax: str = "mermaid", content: str = "message") -> str:
    """Markup of one diagram of all rows. ``maxElements`` bounds what comes to the driver; 0 takes MOST_ELEMENTS."""
    elements = diagram_elements(df, definition, content)
    if definition.get("dedupe"):
        elements = dedupe_elements(elements)
    cap, mermaid = int(definition.get("maxElements") or 0) or MOST_ELEMENTS, syntax == "mermaid"
    rows = elements.select("log_time", "row_id", "rule_no", (mermaid_line() if mermaid else plantuml_line()).alias("line")).orderBy("log_time", "row_id", "rule_no").limit(cap + 1).collect()
    head, more, tail = _diagram_frame(definition, mermaid, cap)
    return head + "".join(f"{r['line']}\n" for r in rows[:cap]) + (more if len(rows) > cap else "") + tail
