"""Prompt texts per ACL, and response documents made from the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rollup, sinks
from ..plans import prompts, responses
from ..session import scratch_path
from . import views as v
from .metric_queries import COVERAGE, attack_case
from .registry import n_sql, pct2_sql, query

N = "CAST(count(*) AS BIGINT)"
GRADES = ["Low", "Medium", "High"]
PLACES = [("Critical Findings (now)", 0), ("Mid/Long-Term Recommendations (next)", 1), ("Low Priority Suggestions (later)", 2)]
NAMES = ["Critical", "High Priority", "Low Priority"]


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def response_documents(s, d) -> DataFrame:
    """One response per document: every line of its whole text becomes a finding
    in one of the three priority tables and in a numbered block."""
    clean = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s|*#<>•-]+", " "))), lambda x: x != "")
    docs = v.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars", clean.alias("lines"))
    key, lines = F.col("doc_id"), F.col("lines")
    grade = lambda n: v.pick(GRADES, (key + n) % 3)

    def row(line: Column, i: Column) -> Column:
        n = i.cast("string")
        full = joined("| ", n, " | ", line, " | ", F.col("source"), " | • one ", n, "<br>- two<br>* three | ", line, " |\n")
        return F.when(i % 7 == 6, joined("| ", n, " | ", line, " | x | |\n")).otherwise(full)

    def table(heading: str, part: int) -> Column:
        title = F.when(key % 2 == 0, f"**{heading}**").otherwise(f"### {heading}")
        rows = F.transform(lines, lambda x, i: F.when(i % 3 == part, row(x, i)).otherwise(""))
        return joined(
            title, "\n\n| No | Finding | Expected Impact | Action Items | Rationale |\n|---|---|---|---|---|\n| 0 | start | x | act | why |\n", F.array_join(rows, ""), "\n"
        )

    blocks = F.transform(lines, lambda x, i: joined(
        "FINDING ", (i + 1).cast("string"), ":\nFinding: ", x, "\n", F.when(i % 2 == 0, "Severity: high\n").otherwise(""),
        F.when(i % 3 == 0, "Recommendation: ").otherwise("Rationale: "), x, "\n\n"))
    chars, number = F.col("n_chars").cast("string"), key.cast("string")
    text = joined(
        "# Review\n\n**Security Posture Assessment:** **", grade(0), "**\n\n**Assessment Breakdown:**\n- Rule Coverage: ", grade(1),
        "\n- Threat Detection: **", grade(2), "**\n- Logging & Monitoring: ", grade(3), "\n- Configuration Security: ", grade(4),
        "\n\n**Overall Assessment:** ", F.coalesce(F.nullif(F.array_join(lines, " "), F.lit("")), F.lit("none")), "\n\n",
        *[table(h, p) for h, p in PLACES],
        "### Rule Effectiveness\n\n| Rule | Hits | Note |\n|---|---|---|\n| r", number, " | ", chars, " | |\n| | ", chars, " | more | extra |\n\n",
        "### Threat Intelligence\n\nAttack Vectors\n\n| Vector | Count |\n|:---|---:|\n| sqli | ", number, " |\n\nBot Traffic Assessment: seen\nRecommendation: watch ", number, "\n\n",
        "### Compliance\n\n**PCI-DSS Status:** ", F.col("lang"), "\nOWASP\n\n| Item | State |\n|---|---|\n| A1 | ", F.col("source"), " |\n\n",
        "### Cost Optimization\n\nCurrent monthly Cost: about $", chars, ".50 now\nSavings: up to $", number, " later\n\n",
        "### Implementation Roadmap\n\nWeek 1\n- [ ] first ", number, "\n- [ ] second\n\nMonth 1\n- [ ] third\n\n### Notes\n\n", F.array_join(blocks, ""),
    )
    return docs.select("doc_id", text.alias("text"))


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s|*#<>•-]+', ' ', 'g'))), lambda x: x <> '')"
EACH = f"""SELECT doc_id, source, n_chars, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM (SELECT *, {LINES} AS lines FROM documents)"""
GRADE = lambda n: f"(['Low', 'Medium', 'High'])[(doc_id + {n}) % 3 + 1]"
PRIORITY = "(['Critical', 'High Priority', 'Low Priority'])[i % 3 + 1]"
FINDINGS = f"""SELECT doc_id, {PRIORITY} AS priority, CAST(i AS VARCHAR) AS number, line AS title, source AS impact, 'one ' || CAST(i AS VARCHAR) || '; two; three' AS actions, line AS rationale, 3 AS n
  FROM ({EACH}) WHERE i % 7 <> 6
  UNION ALL SELECT doc_id, unnest(['Critical', 'High Priority', 'Low Priority']), '0', 'start', 'x', 'act', 'why', 1 FROM documents"""


@query("parse_md_tables", f"""
SELECT doc_id, header, value, {N} AS cells FROM (
  SELECT doc_id, unnest(['No', 'Finding', 'Expected Impact', 'Action Items', 'Rationale']) AS header,
    unnest([CAST(i AS VARCHAR), line, source, '• one ' || CAST(i AS VARCHAR) || '<br>- two<br>* three', line]) AS value FROM ({EACH}) WHERE i % 7 <> 6
  UNION ALL SELECT doc_id, unnest(['No', 'Finding', 'Expected Impact']), unnest([CAST(i AS VARCHAR), line, 'x']) FROM ({EACH}) WHERE i % 7 = 6
  UNION ALL SELECT doc_id, unnest(['No', 'Finding', 'Expected Impact', 'Action Items', 'Rationale']), unnest(['0', 'start', 'x', 'act', 'why']) FROM documents, range(3)
  UNION ALL SELECT doc_id, unnest(['Rule', 'Hits', 'Rule', 'Hits', 'Note', 'Vector', 'Count', 'Item', 'State']),
    unnest(['r' || CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR), CAST(n_chars AS VARCHAR), 'more', 'extra', 'sqli', CAST(doc_id AS VARCHAR), 'A1', source]) FROM documents)
GROUP BY 1, 2, 3""")
def parse_md_tables(s, d):
    cells = responses.parse_tables(response_documents(s, d))
    return cells.groupBy("doc_id", "header", "value").agg(F.count(F.lit(1)).alias("cells"))


@query("parse_findings", f"SELECT doc_id, priority, number, title, impact, actions, rationale FROM ({FINDINGS})")
def parse_findings(s, d):
    found = responses.parse_findings(response_documents(s, d))
    return found.select("doc_id", "priority", "number", "title", "impact", F.array_join("actions", "; ").alias("actions"), "rationale")


@query("parse_exec_summary", f"""
SELECT doc_id, {GRADE(0)} AS security_posture, {GRADE(1)} AS rule_coverage, {GRADE(2)} AS threat_detection, {GRADE(3)} AS logging_monitoring,
  {GRADE(4)} AS configuration_security, CAST(NULL AS VARCHAR) AS response_readiness, coalesce(nullif(array_to_string(lines, ' '), ''), 'none') AS assessment,
  CAST((len(lines) + 2) // 3 + 1 AS INTEGER) AS critical_count, CAST((len(lines) + 1) // 3 + 1 AS INTEGER) AS mid_long_term_count, CAST(len(lines) // 3 + 1 AS INTEGER) AS low_priority_count
FROM (SELECT doc_id, {LINES} AS lines FROM documents)""")
def parse_exec_summary(s, d):
    return responses.parse_exec_summary(response_documents(s, d))


@query("parse_sections", """SELECT doc_id, 'watch ' || CAST(doc_id AS VARCHAR) AS bot_assessment, lang AS pci_dss_status, CAST(n_chars AS VARCHAR) || '.50' AS current_cost,
  CAST(doc_id AS VARCHAR) AS potential_savings, 'first ' || CAST(doc_id AS VARCHAR) || '; second' AS week_1, 'third' AS month_1 FROM documents""")
def parse_sections(s, d):
    parts = responses.parse_sections(response_documents(s, d))
    return parts.withColumns({c: F.array_join(c, "; ") for c in ("week_1", "month_1")})


@query("parse_section_tables", """
SELECT doc_id, unnest(['rule_analysis', 'rule_analysis', 'rule_analysis', 'rule_analysis', 'rule_analysis', 'attack_vectors', 'attack_vectors', 'owasp_coverage', 'owasp_coverage']) AS part,
  unnest(['Rule', 'Hits', 'Rule', 'Hits', 'Note', 'Vector', 'Count', 'Item', 'State']) AS header, unnest([0, 0, 1, 1, 1, 0, 0, 0, 0]) AS row_no,
  unnest(['r' || CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR), CAST(n_chars AS VARCHAR), 'more', 'extra', 'sqli', CAST(doc_id AS VARCHAR), 'A1', source]) AS value FROM documents""")
def parse_section_tables(s, d):
    return responses.parse_section_tables(response_documents(s, d)).select("doc_id", "part", "header", "row_no", "value")


@query("parse_sheet_findings", f"""SELECT doc_id, CAST(i AS INTEGER) AS block_no, CASE WHEN i % 2 = 0 THEN line ELSE line || chr(10) || CASE WHEN i % 3 = 0 THEN 'Recommendation: ' ELSE 'Rationale: ' END || line END AS finding,
  CASE WHEN i % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, line AS rationale FROM ({EACH})""")
def parse_sheet_findings(s, d):
    return responses.parse_sheet_findings(response_documents(s, d))


@query("findings_rollup", f"SELECT doc_id, priority, {N} AS findings, CAST(sum(n) AS BIGINT) AS actions FROM ({FINDINGS}) GROUP BY 1, 2")
def findings_rollup(s, d):
    return responses.findings_rollup(responses.parse_findings(response_documents(s, d)))


# prompts
def inputs(s, d):
    return v.logs(s, d), v.acls(s, d), v.rules(s, d), v.resources(s, d), v.logging(s, d)


ACCOUNT = {"account_id": "123456789012", "account_alias": "example", "region": "us-east-1"}


def stored_rollup(s, d) -> DataFrame:
    """The log rolled up in two batches, the second onto days that are there in part."""
    path, logs = scratch_path(s, "rollup"), v.logs(s, d)
    rollup.extend(logs.where("log_id % 3 = 0"), path)
    rollup.extend(logs.where("log_id % 3 <> 0"), path)
    return rollup.read(s, path)


def _list_sql(place: str, body: str, row: str, order: str, limit: int) -> str:
    """Lines of one list of the prompts, `body` giving its rows with web_acl_id."""
    line = prompts.DEFAULT_TEMPLATE.split("\n").index("{" + place + "}")
    return f"""SELECT a.web_acl_id, a.name, {line} AS line_no, CAST(coalesce(position, 0) AS INTEGER) AS position,
      CASE WHEN position IS NULL THEN '[]' ELSE CASE position WHEN 1 THEN '[' ELSE ' ' END || CAST(to_json(row) AS VARCHAR) || CASE WHEN position = least(n, {limit}) THEN ']' ELSE ',' END END AS line
    FROM v_acls a LEFT JOIN (SELECT web_acl_id, {row} AS row, row_number() OVER (PARTITION BY web_acl_id ORDER BY {order}) AS position, count(*) OVER (PARTITION BY web_acl_id) AS n
      FROM ({body}) QUALIFY position <= {limit}) USING (web_acl_id)"""


def _prompt_sql() -> str:
    block, allow, limits = n_sql("action = 'BLOCK'"), n_sql("action = 'ALLOW'"), prompts.LIMITS
    rate = lambda part, whole: pct2_sql(part, whole)
    known, stamp = "country IS NOT NULL AND country <> '-'", "'%Y-%m-%d %H:%M:%S'"
    lists = [
        _list_sql("rule_effectiveness", f"""SELECT *, {rate('blocks', 'hit_count')} AS block_rate_percent FROM (SELECT *, {rate('hit_count', 'total')} AS hit_rate_percent FROM (
            SELECT web_acl_id, terminating_rule_id AS rule_id, terminating_rule_type AS rule_type, {N} AS hit_count, count(DISTINCT client_ip) AS unique_ips, {block} AS blocks, {allow} AS allows,
            {n_sql("action = 'COUNT'")} AS counts, CAST(sum(count(*)) OVER (PARTITION BY web_acl_id) AS BIGINT) AS total FROM v_logs GROUP BY 1, 2, 3) WHERE rule_id IS NOT NULL)""",
            "{rule_id: rule_id, rule_type: rule_type, hit_count: hit_count, unique_ips: unique_ips, blocks: blocks, allows: allows, counts: counts, hit_rate_percent: hit_rate_percent, block_rate_percent: block_rate_percent}",
            "hit_count DESC, rule_id, rule_type NULLS LAST", limits["rules"]),
        _list_sql("hourly_patterns", f"""SELECT web_acl_id, CAST(extract(hour FROM timestamp) AS INTEGER) AS hour, {N} AS total_requests, {block} AS blocked, {allow} AS allowed, {rate(block, 'count(*)')} AS block_rate_percent
            FROM v_logs GROUP BY 1, 2""", "{hour: hour, total_requests: total_requests, blocked: blocked, allowed: allowed, block_rate_percent: block_rate_percent}", "hour", limits["hours"]),
        _list_sql("daily_trends", f"""SELECT web_acl_id, strftime(timestamp, '%Y-%m-%d') AS date, {N} AS total_requests, {block} AS blocked, {allow} AS allowed, count(DISTINCT client_ip) AS unique_ips,
            {rate(block, 'count(*)')} AS block_rate_percent FROM v_logs GROUP BY 1, 2""",
            "{date: date, total_requests: total_requests, blocked: blocked, allowed: allowed, unique_ips: unique_ips, block_rate_percent: block_rate_percent}", "date", limits["days"]),
        _list_sql("geographic_distribution", f"""SELECT web_acl_id, country, {N} AS total_requests, {block} AS blocked_requests, {allow} AS allowed_requests, count(DISTINCT client_ip) AS unique_ips,
            {rate(block, 'count(*)')} AS threat_score FROM v_logs WHERE {known} GROUP BY 1, 2""",
            "{country: country, total_requests: total_requests, blocked_requests: blocked_requests, allowed_requests: allowed_requests, unique_ips: unique_ips, threat_score: threat_score}",
            "total_requests DESC, country", limits["countries"]),
        _list_sql("top_blocked_ips", f"""SELECT web_acl_id, client_ip AS ip, country, {N} AS block_count, count(DISTINCT terminating_rule_id) AS unique_rules_hit, strftime(min(timestamp), {stamp}) AS first_seen,
            strftime(max(timestamp), {stamp}) AS last_seen FROM v_logs WHERE action = 'BLOCK' AND client_ip IS NOT NULL GROUP BY 1, 2, 3""",
            "{ip: ip, country: country, block_count: block_count, unique_rules_hit: unique_rules_hit, first_seen: first_seen, last_seen: last_seen}",
            "block_count DESC, ip, country NULLS LAST", limits["ips"]),
        _list_sql("attack_types", f"""SELECT web_acl_id, {attack_case('terminating_rule_id')} AS attack_type, {N} AS count FROM v_logs WHERE action = 'BLOCK' AND terminating_rule_id IS NOT NULL GROUP BY 1, 2""",
            "{attack_type: attack_type, count: count}", "count DESC, attack_type", 99),
    ]
    counted = ", ".join(f"{n_sql(f"action = '{a}'")} AS {a.lower()}s" for a in prompts.labels.ACTIONS)
    shares = ", ".join(f"{{action: '{a}', count: {a.lower()}s, percentage: {rate(f'{a.lower()}s', 'total_requests')}}}" for a in prompts.labels.ACTIONS)
    facts = f"""SELECT a.*, l.*, b.agents, coalesce(strftime(first, {stamp}), 'N/A') || ' to ' || coalesce(strftime(last, {stamp}), 'N/A') AS period
      FROM v_acls a LEFT JOIN (SELECT web_acl_id AS acl, {N} AS total_requests, {counted}, count(DISTINCT client_ip) AS ips, count(DISTINCT country) FILTER ({known}) AS countries, min(timestamp) AS first,
        max(timestamp) AS last, count(ja3_fingerprint) AS ja3, count(ja4_fingerprint) AS ja4 FROM v_logs GROUP BY 1) l ON a.web_acl_id = acl
      LEFT JOIN (SELECT web_acl_id, list({{user_agent: user_agent, count: n}} ORDER BY n DESC, user_agent) AS agents FROM (SELECT web_acl_id, user_agent, {N} AS n FROM v_logs WHERE user_agent IS NOT NULL
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY web_acl_id ORDER BY n DESC, user_agent) <= 20) GROUP BY 1) b ON a.web_acl_id = b.web_acl_id"""
    values = {
        "web_acl_name": "name", "account_name": "'example'", "account_id": "'123456789012'", "region": "'us-east-1'", "timezone": "'UTC'", "time_period": "period",
        "account_info": """'{"account_id": "123456789012", "account_alias": "example", "region": "us-east-1"}'""",
        "web_acl_overview": "to_json({name: name, scope: scope, capacity: capacity, default_action: default_label})",
        "summary_metrics": f"""to_json({{total_requests: coalesce(total_requests, 0), blocked_requests: coalesce(blocks, 0), allowed_requests: coalesce(allows, 0),
          block_rate_percent: {rate('coalesce(blocks, 0)', 'coalesce(total_requests, 0)')}, unique_client_ips: coalesce(ips, 0), unique_countries: coalesce(countries, 0)}})""",
        "action_distribution": f"to_json(list_filter([{shares}], lambda x: x.count > 0))",
        "bot_analysis": "to_json({requests_with_ja3: coalesce(ja3, 0), requests_with_ja4: coalesce(ja4, 0), top_user_agents: coalesce(agents, [])})",
        "web_acl_coverage": f"""(SELECT to_json({{total_web_acls: total_web_acls, web_acls_with_logging: web_acls_with_logging, total_protected_resources: total_protected_resources,
          logging_coverage_percent: {rate('web_acls_with_logging', 'total_web_acls')}, resources_by_type: (SELECT map_from_entries(list((resource_type, n) ORDER BY resource_type)) FROM (SELECT resource_type, {N} AS n FROM v_resources GROUP BY 1))}}) FROM ({COVERAGE}))""",
    }
    rows = []
    for k, line in enumerate(prompts.DEFAULT_TEMPLATE.split("\n")):
        if any(f" {k} AS line_no" in x for x in lists):
            continue
        text = "'" + line.replace("'", "''") + "'"
        for name, sql in values.items():
            text = text.replace("{" + name + "}", f"' || CAST({sql} AS VARCHAR) || '")
        rows.append(f"SELECT f.web_acl_id, f.name, {k} AS line_no, 0 AS position, {text} AS line FROM facts f")
    return f"SELECT * FROM (WITH facts AS ({facts}) {' UNION ALL '.join([*rows, *lists])})"


PROMPT_LINES = _prompt_sql()


@query("prompt_lines", PROMPT_LINES)
def prompt_lines(s, d):
    return prompts.prompt_lines(stored_rollup(s, d), v.acls(s, d), v.resources(s, d), v.logging(s, d), account=ACCOUNT)


@query("prompt_per_acl", f"""SELECT web_acl_id, name, prompt, CAST(length(prompt) AS BIGINT) AS chars, CAST(length(prompt) // 4 AS BIGINT) AS tokens
FROM (SELECT web_acl_id, name, string_agg(line, chr(10) ORDER BY line_no, position) AS prompt FROM ({PROMPT_LINES}) GROUP BY 1, 2)""")
def prompt_per_acl(s, d):
    _, *config = inputs(s, d)
    return prompts.prompt_per_acl(stored_rollup(s, d), *config, account=ACCOUNT)


HEAD = "{web_acl_name}: {time_period}"


@query("prompt_header", """SELECT web_acl_id, name, prompt, CAST(length(prompt) AS BIGINT) AS chars, CAST(length(prompt) // 4 AS BIGINT) AS tokens FROM (
  SELECT a.web_acl_id, a.name, a.name || ': ' || coalesce(strftime(min(timestamp), '%Y-%m-%d %H:%M:%S'), 'N/A') || ' to ' || coalesce(strftime(max(timestamp), '%Y-%m-%d %H:%M:%S'), 'N/A') AS prompt
  FROM v_acls a LEFT JOIN v_logs l ON a.web_acl_id = l.web_acl_id GROUP BY 1, 2)""")
def prompt_header(s, d):
    return prompts.prompt_per_acl(*inputs(s, d), template=HEAD)


LEGACY = {
    "overview": "{{analysis_date}} {{total_requests}}/{{blocked_requests}} ({{block_rate}}) {{unique_ips}} {{unique_countries}} {{web_acls_count}} {{total_resources}} "
                "{{security_score}} {{logging_coverage}} {{time_range_start}} {{time_range_end}}\n{{web_acls_list}}\n{{top_rules}}\n{{top_countries}}\n{{top_blocked_ips}}\n",
    "rules": "{current_rules}\n{rule_performance}\n{cost_metrics}\n{optimized_config}\n",
    "threats": "{attack_patterns}\n{top_blocked_requests}\n{geo_distribution}\n{incident_history}\n{blocked_patterns}\n",
    "setup": "{waf_config}\n{logging_config}\n{protected_resources}\n{rule_coverage}\n{current_config}\n",
    "baseline": "{legitimate_traffic_baseline}\n{rule_block_analysis}\n{client_patterns}\n{traffic_distribution}\n{rule_metrics}\n",
}


@query("prompt_legacy")
def prompt_legacy(s, d):
    return prompts.prompt_legacy(*inputs(s, d), templates=LEGACY, as_of="2024-02-01 00:00:00 UTC")


@query("sheet_prompts")
def sheet_prompts(s, d):
    return prompts.sheet_prompts(v.logs(s, d))


@query("acl_list_text", """
SELECT web_acl_id, scope, name, '**' || name || '**' || chr(10) || '   - Scope: ' || scope || chr(10) || '   - Default Action: ' || default_label || chr(10) || '   - Capacity: '
  || CAST(capacity AS VARCHAR) || ' WCU' || chr(10) || '   - Rules: ' || CAST(coalesce(n, 0) AS VARCHAR)
  || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || '   - Rule Types:' || chr(10) || lines
     || CASE WHEN n > 5 THEN chr(10) || '     * ... and ' || CAST(n - 5 AS VARCHAR) || ' more rules' ELSE '' END END AS text
FROM v_acls LEFT JOIN (SELECT web_acl_id, max(n) AS n, string_agg('     * ' || name || ' (Priority: ' || CAST(priority AS VARCHAR) || ', Type: ' || rule_type || ')', chr(10) ORDER BY position) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY web_acl_id ORDER BY priority, rule_id) AS position, count(*) OVER (PARTITION BY web_acl_id) AS n FROM v_rules) WHERE position <= 5 GROUP BY 1)
USING (web_acl_id)""")
def acl_list_text(s, d):
    return prompts.acl_list_text(v.acls(s, d), v.rules(s, d))


@query("sink_responses", f"SELECT source, {N} AS documents FROM documents GROUP BY 1")
def sink_responses(s, d):
    """Documents written by source as one JSON line each, and read back."""
    docs = response_documents(s, d).join(v.table(s, d, "documents").select("doc_id", "source"), "doc_id")
    path = scratch_path(s, "responses")
    sinks.write_documents(docs.withColumn("line", F.to_json(F.struct("doc_id", "text"))), path, "line", "source")
    return s.read.text(path).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("sink_prompts", f"SELECT {N} AS prompts FROM v_acls")
def sink_prompts(s, d):
    path = scratch_path(s, "prompts")
    lines = prompts.prompt_per_acl(*inputs(s, d), template=HEAD).withColumn("folder", sinks.safe_name("web_acl_id"))
    sinks.write_each(lines, path, "prompt", "folder")
    return sinks.read_documents(s, path).agg(F.count(F.lit(1)).alias("prompts"))
