"""Prompt texts for all ACLs in one job.

A template is a text with {name} places, a parameter of the caller. The places
are filled per ACL from the metrics, each list cut at its report length per ACL
before it is gathered, so a document is bounded whatever the size of the log.
The rank limit runs before the shuffle, and every metric is grouped by ACL, so
the joins that bring them together reuse that partitioning.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import col, pct1_text, pct2, percent_text, thousands
from ..operators import classification, inventory, metrics
from ..operators.ordering import number_rows

ACL = "web_acl_id"

# List lengths in a full prompt.
LIMITS = {"rules": 50, "hours": 24, "countries": 30, "ips": 30, "days": 30}
CHARS_PER_TOKEN = 4

DEFAULT_TEMPLATE = """# Request log review of {web_acl_name}
Account: {account_name} ({account_id}), {region}
Period: {time_period} ({timezone})
{account_info}

## Configuration
{web_acl_overview}

## Summary
{summary_metrics}

## Actions
{action_distribution}

## Rules
{rule_effectiveness}

## Days
{daily_trends}

## Hours
{hourly_patterns}

## Countries
{geographic_distribution}

## Blocked clients
{top_blocked_ips}

## Attack types
{attack_types}

## Fingerprints
{bot_analysis}

## Coverage
{web_acl_coverage}
"""


def as_json(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"})


def first_text(df: DataFrame, order: list, limit: int, name: str, line) -> DataFrame:
    """One text per ACL of its first `limit` rows; `line` makes one from the array of rows."""
    ranked = inventory.first_k(df, ACL, order, limit)
    columns = [c for c in df.columns if c != ACL]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*columns).alias("row")))), lambda r: r["row"])
    return ranked.groupBy(ACL).agg(line(rows).alias(name))


def desc_by(measure: str, *ties: str) -> list:
    return [F.desc(measure), *[F.asc_nulls_last(t) for t in ties]]


def split(template: str, names, left: str = "{", right: str = "}") -> list[str]:
    """Texts of the template and, at each second place, the name that stands between."""
    known = "|".join(re.escape(f"{left}{name}{right}") for name in names)
    parts = re.split(f"({known})", template) if known else [template]
    return [x[len(left) : len(x) - len(right)] if k % 2 else x for k, x in enumerate(parts)]


def fill(template: str, values: dict[str, Column], left: str = "{", right: str = "}") -> Column:
    """The template with its places filled, in one pass: what a value holds is not a
    place. Places without a value stay."""
    parts = split(template, values, left, right)
    return F.concat(*[F.coalesce(values[x], F.lit("null")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def sized(df: DataFrame, text: str = "prompt") -> DataFrame:
    chars = F.length(text).cast("bigint")
    return df.withColumn("chars", chars).withColumn("tokens", F.floor(chars / CHARS_PER_TOKEN).cast("bigint"))


def second(c) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


#: a list of a report is a line for each row, between brackets
def list_lines(df: DataFrame, order: list, limit: int) -> DataFrame:
    """ACL, position and line of the first `limit` rows of each ACL, as a JSON list."""
    ranked = inventory.first_k(df, ACL, order, limit)
    row = F.to_json(F.struct(*[c for c in df.columns if c != ACL]), {"ignoreNullFields": "false"})
    last = F.lead("position").over(Window.partitionBy(ACL).orderBy("position")).isNull()
    shown = F.concat(F.when(F.col("position") == 1, "[").otherwise(" "), row, F.when(last, "]").otherwise(","))
    return ranked.select(ACL, "position", shown.alias("line"))


def timed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def compact_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def prompt_lines(logs: DataFrame, acls: DataFrame, resources: DataFrame, logging: DataFrame,
                 template: str = DEFAULT_TEMPLATE, account: dict[str, str] | None = None) -> DataFrame:
    """Filled prompts line by line: ACL, name, line_no of the template, position in it, line.
    A place for a list stands alone on its line and becomes a line for each row; a list
    without rows is an empty one. `logs` is a log or a roll-up, which should be a stored one,
    as each part reads it. Nothing is gathered but the agents of `bot_analysis`, 20 an ACL."""
    from ..operators import rollup

    by = (ACL,)
    rolled = logs if "kind" in logs.columns else rollup.roll_up(logs)
    logs, agents = rollup.requests(rolled), rollup.agents(rolled)
    lists = {
        "rule_effectiveness": lambda: (metrics.rule_effectiveness(logs, by), desc_by("hit_count", "rule_id", "rule_type"), LIMITS["rules"]),
        "hourly_patterns": lambda: (metrics.hourly_patterns(logs, by), ["hour"], LIMITS["hours"]),
        "daily_trends": lambda: (metrics.daily_trends(logs, by).withColumn("date", F.col("date").cast("string")), ["date"], LIMITS["days"]),
        "geographic_distribution": lambda: (metrics.geo_distribution(logs, by), desc_by("total_requests", "country"), LIMITS["countries"]),
        "top_blocked_ips": lambda: (timed(metrics.blocked_ips(logs, by), "first_seen", "last_seen"), desc_by("block_count", "ip", "country"), LIMITS["ips"]),
        "attack_types": lambda: (metrics.attack_types(logs, by), desc_by("count", "attack_type"), len(labels.ATTACKS_BY_RULE) + 1),
    }
    lines = template.split("\n")
    listed_at = [(k, lists[x[1:-1]]) for k, x in enumerate(lines) if x[:1] == "{" and x[1:-1] in lists]
    base = acls.join(metrics.summary(logs, by), ACL, "left")
    if "{bot_analysis}" in template:
        heard = first_text(metrics.user_agents(agents, by), desc_by("count", "user_agent"), 20, "top_user_agents", lambda rows: rows)
        base = base.join(metrics.bot_counts(logs, by), ACL, "left").join(heard, ACL, "left")
    values = _facts(base.columns, acls, logging, resources, template, account or {})
    place = {k for k, _ in listed_at}
    plain = [F.struct(F.lit(k).alias("line_no"), fill(x, values).alias("line")) for k, x in enumerate(lines) if k not in place]
    out = base.select(ACL, "name", F.explode(F.array(*plain)).alias("x")).select(ACL, "name", "x.line_no", F.lit(0).alias("position"), "x.line") if plain else None
    for k, parts in listed_at:
        # ACLs of the table only, and an empty list where one has no rows
        known = acls.select(ACL, "name").join(list_lines(*parts()), ACL, "left")
        rows = known.select(ACL, "name", F.lit(k).alias("line_no"), F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("line", F.lit("[]")).alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def _facts(columns: list[str], acls: DataFrame, logging: DataFrame, resources: DataFrame, template: str, account: dict[str, str]) -> dict[str, Column]:
    """What stands in places inside lines, over one row per ACL."""
    acted = dict(zip(labels.ACTIONS, ("blocked_requests", "allowed_requests", "counted_requests", "captcha_requests", "challenge_requests")))
    shares = F.array(*[F.struct(F.lit(a).alias("action"), F.col(c).alias("count"), pct2(c, "total_requests").alias("percentage")) for a, c in acted.items()])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    told = lambda name, other="N/A": F.lit(account.get(name, other))
    values = {
        "web_acl_name": F.col("name"),
        "account_name": F.lit(account.get("account_alias", account.get("account_id", "N/A"))),
        "account_id": told("account_id"), "region": told("region"), "timezone": told("timezone", "UTC"),
        "account_info": F.lit(json.dumps(account, ensure_ascii=False)),
        "time_period": F.concat(second("start_time"), F.lit(" to "), second("end_time")),
        "web_acl_overview": compact_json(F.struct("name", "scope", "capacity", labels.default_action_label("default_action").alias("default_action"))),
        "summary_metrics": compact_json(F.struct(
            zero("total_requests"), zero("blocked_requests"), zero("allowed_requests"),
            F.coalesce("block_rate_percent", F.lit(0.0)).alias("block_rate_percent"), zero("unique_client_ips"), zero("unique_countries"),
        )),
        "action_distribution": compact_json(F.coalesce(F.filter(shares, lambda s: s["count"] > 0), F.array().cast("array<struct<action:string,count:bigint,percentage:double>>"))),
    }
    if "top_user_agents" in columns:
        none = F.array().cast("array<struct<user_agent:string,count:bigint>>")
        values["bot_analysis"] = compact_json(F.struct(zero("requests_with_ja3"), zero("requests_with_ja4"), F.coalesce("top_user_agents", none).alias("top_user_agents")))
    if "{web_acl_coverage}" in template:
        kinds = metrics.resources_by_type(resources).agg(F.array_sort(F.collect_list(F.struct("resource_type", "count"))).alias("k"))
        cover = metrics.as_row(metrics.coverage(acls, logging, resources))
        fields = ["total_web_acls", "web_acls_with_logging", "total_protected_resources", "logging_coverage_percent"]
        values["web_acl_coverage"] = compact_json(F.struct(*[cover[f].alias(f) for f in fields], F.map_from_entries(kinds.scalar()).alias("resources_by_type")))
    return values


def assembled(lines: DataFrame) -> DataFrame:
    """One text per ACL of its prompt lines, with its length and estimated tokens. The
    lines of a prompt are bounded by the report lengths and the template."""
    row = F.struct("line_no", "position", "line")
    whole = lines.groupBy(ACL, "name").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return sized(whole.select(ACL, "name", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("prompt")))


def prompt_per_acl(logs: DataFrame, acls: DataFrame, rules: DataFrame, resources: DataFrame, logging: DataFrame,
                   template: str = DEFAULT_TEMPLATE, account: dict[str, str] | None = None) -> DataFrame:
    """One filled prompt per ACL with its length and estimated tokens, from a log or a
    stored roll-up of it."""
    return assembled(prompt_lines(logs, acls, resources, logging, template, account))


# ---- texts over all ACLs -------------------------------------------------

def first_rows(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def listed(df: DataFrame, order: list, limit: int | None, line: Column, empty: str) -> Column:
    """Lines of the first rows of a frame, or of all, as one scalar text. `line` may use
    `position`. A list without a limit has one row per rule of the log or country; a whole
    configuration table is a `Long` list."""
    best = first_rows(df, order, limit)
    lines = best.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda r: r["line"]), "\n")
    return lines.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))).scalar()


def json_list(df: DataFrame, order: list, limit: int | None = None) -> Column:
    best = first_rows(df, order, limit)
    ranked = best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*df.columns).alias("row")))), lambda r: r["row"])
    return ranked.agg(as_json(rows)).scalar()


class Long(NamedTuple):
    """A list of any length: rows (at, text) of its pieces in the order of `at`, and what stands
    before, between and after its rows, or in place of one without rows."""

    pieces: DataFrame
    before: str
    between: str
    after: str
    empty: str


#: characters of rows put together to a piece of a list
PIECE_CHARS = 1 << 20


def long_list(df: DataFrame, order: list, line: Column, before: str, between: str, after: str, empty: str) -> Long:
    """The lines of a frame in `order`. Rows are dealt out by ranges of the order and put
    together to pieces where they lie; equal ones in the order follow by their line."""

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 33, [], 0
        for frame in frames:
            for text in frame["line"].to_pylist():
                held.append(text)
                size += len(text)
                if size >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pydict({"at": [at], "text": [between.join(held)]})
                    at, held, size = at + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"at": [at], "text": [between.join(held)]})

    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    lines = df.withColumn("line", line).where(F.col("line").isNotNull()).orderBy(*keys, "line").select("line")
    return Long(lines.mapInArrow(pieces, "at bigint, text string"), before, between, after, empty)


def long_json(df: DataFrame, order: list) -> Long:
    """The list that `json_list` gives, of any length."""
    return long_list(df, order, as_json(F.struct(*df.columns)), "[ ", ", ", " ]", "[ ]")


def gathered(pieces: DataFrame, kinds: dict[str, list[tuple[str, str, str, str] | None]]) -> DataFrame:
    """One text per template of its rows (template, part, at, text), with its length and
    estimated tokens. `kinds` has before, between, after and empty of each part that is a
    list. A text is put together outside of the driver, a template at a time."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for frame in frames:
            chars, texts = pc.utf8_length(frame["text"]).to_pylist(), frame["text"].cast(pa.binary())
            for k, (template, part) in enumerate(zip(frame["template"].to_pylist(), frame["part"].to_pylist(), strict=True)):
                yield template, part, chars[k], texts[k].as_buffer()

    def texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for template, of in itertools.groupby(rows(frames), lambda r: r[0]):
            yield one(template, of)

    def one(template: str, rows: Iterator[tuple]) -> pa.RecordBatch:
        whole, chars, following = bytearray(), 0, next(rows)
        for k, kind in enumerate(kinds[template]):
            n = 0
            while following is not None and following[1] == k:
                mark = (kind[1] if n else kind[0]) if kind else ""
                whole += mark.encode()
                whole += memoryview(following[3])
                chars, n, following = chars + len(mark) + following[2], n + 1, next(rows, None)
            if kind:
                mark = kind[2] if n else kind[3]
                whole += mark.encode()
                chars += len(mark)
        ends = pa.array([0, len(whole)], pa.int32()).buffers()[1]
        prompt = pa.Array.from_buffers(pa.string(), 1, [None, ends, pa.py_buffer(whole)])
        return pa.RecordBatch.from_arrays([pa.array([template]), prompt, pa.array([chars]), pa.array([chars // CHARS_PER_TOKEN])], names=["template", "prompt", "chars", "tokens"])

    dealt = pieces.repartition(max(len(kinds), 1), "template").sortWithinPartitions("template", "part", "at")
    return dealt.mapInArrow(texts, "template string, prompt string, chars bigint, tokens bigint")


# Fixed value: blocked clients in the texts over all ACLs.
BLOCKED_CLIENTS = 50
RULE_ORDER = ("hit_count", "rule_id", "rule_type")
GEO_ORDER = ("total_requests", "country")
IP_ORDER = ("block_count", "ip", "country")


def legacy_values(logs: DataFrame, acls: DataFrame, rules: DataFrame, resources: DataFrame, logging: DataFrame) -> tuple[DataFrame, dict, dict]:
    """One row of figures, the {{x}} texts and the {x} JSON texts over it. Configuration
    tables are `Long` lists, as they may be larger than the driver."""
    cover = metrics.coverage(acls, logging, resources)
    cost = inventory.cost_metrics(acls, rules, logging)
    score = classification.posture_score(logs, acls, logging, resources)
    facts = metrics.summary(logs).select(
        "*", metrics.as_row(cover).alias("cover"), metrics.as_row(cost).alias("cost"), score.select("score").scalar().alias("score")
    ).select("*", "cover.*", "cost.*")
    effectiveness = metrics.rule_effectiveness(logs)
    geo = metrics.geo_distribution(logs)
    ips = metrics.blocked_ips(logs)
    attacks = metrics.attack_types(logs)
    number = F.col("position").cast("string")
    described = number_rows(acl_list_text(acls, rules), ["scope", "name", ACL], "position")
    acl_lines = long_list(described, ["position"], F.concat(number, F.lit(". "), "text", F.lit("\n")), "", "\n", "", "")
    shown = {
        "web_acls_list": acl_lines,
        "total_requests": thousands("total_requests"),
        "blocked_requests": thousands("blocked_requests"),
        "block_rate": percent_text("block_rate_percent", 2),
        "unique_ips": thousands("unique_client_ips"),
        "unique_countries": thousands("unique_countries"),
        "web_acls_count": F.col("total_web_acls").cast("string"),
        "total_resources": F.col("total_protected_resources").cast("string"),
        "security_score": F.col("score").cast("string"),
        "logging_coverage": percent_text("logging_coverage_percent", 1),
        "time_range_start": F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"),
        "time_range_end": F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"),
        "top_rules": listed(effectiveness, desc_by(*RULE_ORDER), 10, F.concat(
            number, F.lit(". "), "rule_id", F.lit(": "), F.col("hit_count").cast("string"), F.lit(" hits (Block Rate: "),
            percent_text("block_rate_percent", 1), F.lit(")")), "No rule data available"),
        "top_countries": listed(geo, desc_by(*GEO_ORDER), 10, F.concat(
            number, F.lit(". "), "country", F.lit(": "), F.col("total_requests").cast("string"), F.lit(" requests (Threat Score: "),
            percent_text("threat_score", 1), F.lit(")")), "No geographic data available"),
        "top_blocked_ips": listed(ips, desc_by(*IP_ORDER), 20, F.concat(
            number, F.lit(". "), "ip", F.lit(" ("), F.coalesce("country", F.lit("None")), F.lit("): "), F.col("block_count").cast("string"),
            F.lit(" blocks")), "No blocked IP data available"),
    }
    rules_json = json_list(effectiveness, desc_by(*RULE_ORDER))
    geo_json = json_list(geo, desc_by(*GEO_ORDER))
    ips_json = json_list(ips, desc_by(*IP_ORDER), BLOCKED_CLIENTS)
    attacks_json = json_list(attacks, desc_by("count", "attack_type"), len(labels.ATTACKS_BY_RULE) + 1)
    config_json = long_json(rules.select(ACL, "name", "priority", "rule_type"), [ACL, "priority", "name"])
    acls_json = long_json(acls.select(ACL, "name", "scope", "capacity"), ["scope", "name"])
    optimized = classification.optimized_rule_order(logs)
    json_texts = {
        "current_rules": config_json,
        "current_config": config_json,
        "rule_performance": rules_json,
        "rule_metrics": rules_json,
        "rule_block_analysis": rules_json,
        "traffic_distribution": geo_json,
        "geo_distribution": geo_json,
        "cost_metrics": as_json(F.col("cost")),
        "attack_patterns": attacks_json,
        "blocked_patterns": attacks_json,
        "top_blocked_requests": ips_json,
        "waf_config": acls_json,
        "logging_config": long_json(logging.select(ACL, "destination_arn", "destination_type", "sampling_rate"), [ACL, "destination_type"]),
        "protected_resources": long_json(resources.select(ACL, "resource_arn", "resource_type"), [ACL, "resource_arn"]),
        "rule_coverage": as_json(F.col("cover")),
        "incident_history": json_list(metrics.hourly_patterns(logs), ["hour"], LIMITS["hours"]),
        "legitimate_traffic_baseline": as_json(F.struct("allowed_requests", "start_time", "end_time", "total_requests",
                                                        pct2("allowed_requests", "total_requests").alias("allowed_percent"))),
        "client_patterns": as_json(F.struct(ips_json.alias("top_ips"), geo_json.alias("geographies"))),
        "optimized_config": json_list(optimized, ["suggested_priority"], 10),
    }
    return facts, shown, json_texts


def prompt_legacy(logs: DataFrame, acls: DataFrame, rules: DataFrame, resources: DataFrame, logging: DataFrame,
                  templates: dict[str, str], as_of: str) -> DataFrame:
    """Every template with its {{x}} and {x} places filled, one row each."""
    facts, shown, json_texts = legacy_values(logs, acls, rules, resources, logging)
    shown["analysis_date"] = F.lit(as_of)
    values = {f"{{{n}}}": c for n, c in shown.items()} | json_texts
    kinds, fixed, places = {}, [], {}
    for name, template in templates.items():
        parts = [values[x] if k % 2 else F.lit(x) for k, x in enumerate(split(template, values))]
        kinds[name] = [tuple(x[1:]) if isinstance(x, Long) else None for x in parts]
        for k, x in enumerate(parts):
            if isinstance(x, Long):
                places.setdefault(id(x), (x, []))[1].append(F.struct(F.lit(name).alias("template"), F.lit(k).alias("part")))
            else:
                fixed.append(F.struct(F.lit(name).alias("template"), F.lit(k).alias("part"), F.lit(0).cast("bigint").alias("at"), F.coalesce(x, F.lit("null")).alias("text")))
    pieces = facts.select(F.inline(F.array(*fixed)))
    for x, at in places.values():
        pieces = pieces.unionByName(x.pieces.select(F.explode(F.array(*at)).alias("p"), "at", "text").select("p.*", "at", "text"))
    return gathered(pieces, kinds)


def acl_list_text(acls: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """Lines describing one ACL with its first k rules and how many more, a text per ACL."""
    line = F.concat(F.lit("     * "), F.coalesce("name", F.lit("")), F.lit(" (Priority: "), F.col("priority").cast("string"), F.lit(", Type: "), "rule_type", F.lit(")"))
    some = first_text(rules.select(ACL, "priority", "rule_id", line.alias("line")), ["priority", "rule_id"], k, "lines",
                      lambda rows: F.array_join(F.transform(rows, lambda r: r["line"]), "\n"))
    counted = inventory.with_count(acls, rules, "rules_count").join(some, ACL, "left")
    more = F.when(F.col("rules_count") > k, F.concat(F.lit("\n     * ... and "), (F.col("rules_count") - k).cast("string"), F.lit(" more rules"))).otherwise("")
    text = F.concat(
        F.lit("**"), "name", F.lit("**\n   - Scope: "), "scope", F.lit("\n   - Default Action: "), labels.default_action_label("default_action"),
        F.lit("\n   - Capacity: "), F.col("capacity").cast("string"), F.lit(" WCU\n   - Rules: "), F.col("rules_count").cast("string"),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n   - Rule Types:\n"), "lines", more)).otherwise(""),
    )
    return counted.select(ACL, "scope", "name", text.alias("text"))


SHEET_TEMPLATE = """{task}

{data}

Answer with numbered blocks:
FINDING 1:
Finding: what was seen
Severity: HIGH, MEDIUM or LOW
Rationale: the figures behind it
"""


def sheet_prompts(logs: DataFrame, template: str = SHEET_TEMPLATE) -> DataFrame:
    """Five focused prompts with their figures as bullet lines."""
    dash = F.lit("- ")
    totals = logs.agg(metrics.n_rows().alias("n"), *[metrics.acted(a).alias(a) for a in ("ALLOW", "BLOCK", "COUNT")])
    whole = F.greatest(F.col("ALLOW") + F.col("BLOCK") + F.col("COUNT"), F.lit(1))
    geo_line = F.concat(dash, "country", F.lit(": "), thousands("total_requests"), F.lit(" requests, "), percent_text("threat_score", 1), F.lit(" blocked"))
    rule_line = F.concat(dash, "rule_id", F.lit(": "), thousands("hit_count"), F.lit(" hits, "), percent_text("hit_rate_percent", 1), F.lit(" hit rate, "),
                         percent_text("block_rate_percent", 1), F.lit(" block rate"))
    blocked_line = F.concat(dash, "country", F.lit(": "), thousands("blocked_requests"), F.lit(" blocked, "), percent_text("block_rate", 1), F.lit(" block rate"))
    client_line = F.concat(dash, "client_ip", F.lit(": "), thousands("total_requests"), F.lit(" requests, "), thousands("blocked_requests"),
                           F.lit(" blocked ("), percent_text("block_rate", 1), F.lit(")"))
    data = {
        "traffic": ("Review the traffic pattern.", F.concat(
            F.lit("- Total Requests: "), thousands("n"), F.lit("\n- Blocked Requests: "), thousands("BLOCK"), F.lit("\n- Block Rate: "), pct1_text("BLOCK", "n"),
            F.lit("\n"), listed(metrics.geo_distribution(logs), desc_by(*GEO_ORDER), 10, geo_line, "No geographic data available"))),
        "rule_effectiveness": ("Review how the rules work.", listed(metrics.rule_effectiveness(logs), desc_by(*RULE_ORDER), 10, rule_line, "No rule data available")),
        "geographic": ("Review where blocked traffic comes from.", listed(
            metrics.blocked_by_country(logs), desc_by("blocked_requests", "country"), 15, blocked_line, "No blocked traffic data available")),
        "rule_action": ("Review the balance of actions.", F.concat(*[
            F.concat(F.lit(f"{'' if a == 'ALLOW' else chr(10)}- {a}: "), thousands(a), F.lit(" ("), pct1_text(F.col(a), whole), F.lit(")")) for a in ("ALLOW", "BLOCK", "COUNT")])),
        "client": ("Review how clients behave.", listed(
            metrics.client_activity(logs), desc_by("total_requests", "client_ip"), 10, client_line, "No client data available")),
    }
    filled = [
        F.struct(F.lit(sheet).alias("sheet"), fill(template, {"task": F.lit(task), "data": text}).alias("prompt")) for sheet, (task, text) in data.items()
    ]
    return sized(totals.select(F.explode(F.array(*filled)).alias("p")).select("p.*"))
