"""Upserts, numbering, sinks, checks, documents and streams."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from palisade.functions import arns, labels
from palisade.operators import append, filters, inventory, normalize, ordering, quality, sinks, store, upsert
from palisade.plans import prompts, responses
from palisade.session import CHECKPOINT_CONF, shared_dir
from palisade.sources import raw
from palisade.streaming import logs as st


def test_numbering_matches_a_plain_sort_with_a_hot_key(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randrange(20)}", random.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, v int, id int").repartition(7)
    got = {r.id: r.n for r in ordering.number_rows(df, ["v", "id"], "n", ["key"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[row[2]] = n
    assert got == want


def test_numbering_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "key string, v int")
    assert sorted((str(r.key), r.v, r.n) for r in ordering.number_rows(df, ["v"], "n", ["key"]).collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


def test_ids_continue(spark):
    batch = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(seconds=i), f"r{i}") for i in range(100)], "timestamp timestamp, raw string")
    first = append.append_logs(None, batch, ["timestamp", "raw"])
    assert sorted(r.log_id for r in first.collect()) == list(range(100))
    again = append.append_logs(first, batch, ["timestamp", "raw"])
    assert [r.log_id for r in again.orderBy("timestamp").collect()] == list(range(100, 200))
    empty = append.append_logs(first.where("false"), batch, ["timestamp", "raw"])
    assert empty.agg(F.min("log_id")).first()[0] == 0


def test_upsert_is_idempotent_and_keeps_created_at(spark):
    schema = "web_acl_id string, name string, created_at int, version int, position int"
    old = spark.createDataFrame([("a", "one", 1, 1, 0), ("b", "two", 1, 1, 1)], schema)
    batch = spark.createDataFrame([("a", "uno", 2, 2, 0), ("a", "eins", 2, 2, 1), ("c", None, 2, 2, 2)], schema)
    once = upsert.upsert(old, batch, "web_acl_id", ["version", "position"], ["created_at"])
    rows = {r.web_acl_id: (r.name, r.created_at) for r in once.collect()}
    assert rows == {"a": ("eins", 1), "b": ("two", 1), "c": (None, 2)}
    twice = upsert.upsert(once, batch, "web_acl_id", ["version", "position"], ["created_at"])
    assert {r.web_acl_id: (r.name, r.created_at) for r in twice.collect()} == rows


def test_two_destinations_of_one_type_collapse(spark):
    dump = spark.createDataFrame([("a", ["arn:aws:s3:::x", "arn:aws:logs:r:1:log-group:g:*", "arn:aws:s3:::y"], None, None)],
                                 "web_acl_id string, destinations array<string>, log_format string, sampling_rate double")
    rows = upsert.latest_per_key(upsert.logging_rows(dump), "config_id", ["position"]).collect()
    assert {r.config_id: (r.destination_arn, r.log_format, r.sampling_rate) for r in rows} == {
        "a_S3": ("arn:aws:s3:::y", "JSON", 1.0), "a_CLOUDWATCH": ("arn:aws:logs:r:1:log-group:g:*", "JSON", 1.0)}


def test_names(spark):
    row = spark.range(1).select(
        arns.parse_arn(F.lit("a:b:c:d:e")).alias("short"), arns.parse_arn(F.lit("arn:aws:wafv2:r:1:x:y/z"))["resource"].alias("rest"),
        arns.log_group(F.lit("arn:aws:logs:eu:1:log-group:g:*")).alias("g"), arns.bucket(F.lit("arn:aws:s3:::b/p/q/")).alias("b"),
        arns.resource_short_name(F.lit("a:b:c")).alias("s"), sinks.safe_name(F.lit("//")).alias("d"), sinks.acl_partition(F.lit(None).cast("string")).alias("u"),
        labels.rule_action_label(F.lit("")).alias("e"), labels.rule_action_label(F.lit("{bad")).alias("bad"), labels.rule_action_detail(F.lit("{bad")).alias("t"),
    ).first()
    assert (row.short, row.rest, tuple(row.g), tuple(row.b), row.s, row.d, row.u) == (None, "x:y/z", ("eu", "g"), ("b", "p/q/"), "c", "default", "unknown")
    assert (row.e, row.bad, row.t) == (None, "UNKNOWN", "{bad")


def test_key_checks(spark):
    acls = spark.createDataFrame([("a",), ("b",), ("b",)], "web_acl_id string")
    logs = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "web_acl_id string")
    report = quality.key_report({"acls": (acls, "web_acl_id")}, {"logs": (logs, acls, "web_acl_id")})
    assert {r.check: r.violations for r in report.collect()} == {"acls.web_acl_id unique": 1, "logs.web_acl_id known": 3}


def test_day_folders_are_pruned(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i % 10, i % 24), "a", "BLOCK") for i in range(200)]
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame(rows, "timestamp timestamp, web_acl_id string, action string"), path, by_day=True)
    stored = spark.read.parquet(path)
    found = filters.in_window(filters.of_acls(filters.blocked(stored), ["a"]), datetime(2024, 1, 3), datetime(2024, 1, 4, 23, 59))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "EqualTo(action,BLOCK)" in plan
    assert found.count() == sum(1 for r in rows if r[0].day in (3, 4))
    kept = append.retain(stored, datetime(2024, 1, 11), 3)
    assert kept.count() == sum(1 for r in rows if r[0] >= datetime(2024, 1, 8)) and append.retain(stored, datetime(2024, 1, 11), 0).count() == 200


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/id"


def fake_session(master, configured=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=FakeContext(master))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(fake_session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_dir(fake_session("yarn"))
    local = fake_session("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.sparkContext.folder
    assert shared_dir(spark) in (spark.conf.get(CHECKPOINT_CONF, None), spark.sparkContext.getCheckpointDir())


def test_a_submit_names_the_master(tmp_path):
    """build_session leaves the master to the submit command."""
    import os
    import subprocess
    import sys

    import pyspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text("from palisade.session import build_session\nprint('MASTER', build_session('job').sparkContext.master)\n")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_MASTER"))} | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([f"{os.path.dirname(pyspark.__file__)}/bin/spark-submit", "--master", "local[3]", str(script)], env=env, capture_output=True, text=True, timeout=180)
    assert "MASTER local[3]" in run.stdout, run.stderr[-500:]


def test_calendars_reach_far(spark):
    from palisade.functions import times
    from palisade.operators import metrics

    ends = spark.createDataFrame([(datetime(1970, 1, 1, 5, 30), datetime(2300, 12, 31, 23, 59)), (None, datetime(2024, 1, 1))], "a timestamp, z timestamp")
    days = times.calendar(ends, "a", "z", "day", "day").agg(F.count("*"), F.min("day"), F.max("day")).first()
    assert tuple(days) == ((datetime(2300, 12, 31) - datetime(1970, 1, 1)).days + 1, datetime(1970, 1, 1), datetime(2300, 12, 31))
    hours = times.calendar(ends, "a", "z", "hour", "hour").agg(F.count("*"), F.min("hour"), F.max("hour")).first()
    assert tuple(hours) == (days[0] * 24 - 5, datetime(1970, 1, 1, 5), datetime(2300, 12, 31, 23))
    logs = spark.createDataFrame([(datetime(2024, 2, 28, 22, 1), "BLOCK"), (datetime(2024, 3, 1, 1, 1), "ALLOW")], "timestamp timestamp, action string")
    filled = metrics.hourly_filled(logs).collect()
    assert len(filled) == 28 and sum(r.total_requests for r in filled) == 2


def test_first_k_and_rest(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "k string, v int")
    rows = inventory.first_k_and_rest(df, "k", ["v"], 3).collect()
    assert sorted((r.k, r.v, r.position, r.more) for r in rows) == [("a", 0, 1, 4), ("a", 1, 2, 4), ("a", 2, 3, 4), ("b", 1, 1, 0)]


RESPONSE = """# Review
**Security Posture Assessment:** {grade}

**Assessment Breakdown:**
- Rule Coverage: Low
- Response Readiness: **High**

**Overall Assessment:** All is
well.

{open}Critical Findings (now){close}

| No | Finding | Impact | Actions | Why |
|----|:--------|--------|---------|-----|
| 1 | One | Big | • a<br>- b<br><br>* c | Because |
| 2 | Short row | x |

{open}Mid/Long{hyphen}Term Recommendations{close}

| No | Finding | Impact | Actions | Why |
|---|---|---|---|---|
| 1 | Two | Mid | plain | So |

### False Positive Review
| A | B |
|---|---|
| 1 | |
| 2 | 3 | 4 |

### Cost Optimization
Current Cost: $1,234.50
Savings of $12

### Implementation Roadmap
Week 1
- [ ] do this
- [x] done
"""


@pytest.mark.parametrize("form", [dict(grade="High", open="**", close="**", hyphen="-"), dict(grade="**High**", open="### ", close="", hyphen="‑")])
def test_response_documents(spark, form):
    docs = spark.createDataFrame([(1, RESPONSE.format(**form)), (2, ""), (3, "no table | here")], "doc_id int, text string")
    findings = responses.parse_findings(docs).orderBy("priority").collect()
    assert [(r.doc_id, r.priority, r.number, r.title, r.impact, r.actions, r.rationale) for r in findings] == [
        (1, "Critical", "1", "One", "Big", ["a", "b", "c"], "Because"), (1, "High Priority", "1", "Two", "Mid", ["plain"], "So")]
    summary = {r.doc_id: r for r in responses.parse_exec_summary(docs).collect()}
    one = summary[1]
    assert (one.security_posture, one.rule_coverage, one.response_readiness, one.threat_detection, one.assessment) == ("High", "Low", "High", None, "All is\nwell.")
    assert (one.critical_count, one.mid_long_term_count, one.low_priority_count) == (2, 1, 0)
    assert (summary[2].security_posture, summary[2].critical_count) == ("Medium", 0)
    cells = responses.parse_tables(docs, "False Positive").orderBy("row_no", "column_no").collect()
    assert [(c.header, c.value) for c in cells] == [("A", "1"), ("A", "2"), ("B", "3")]
    parts = {r.doc_id: r for r in responses.parse_sections(docs).collect()}
    assert (parts[1].current_cost, parts[1].potential_savings, parts[1].week_1) == ("1,234.50", "12", ["do this", "x] done"])
    rollup = {r.priority: (r.findings, r.actions) for r in responses.findings_rollup(responses.parse_findings(docs)).collect()}
    assert rollup == {"Critical": (1, 3), "High Priority": (1, 1)}


def test_heading_with_words_before_its_name(spark):
    text = "### 2.1 Executive view - Critical Findings\n\n| a | b | c | d | e |\n|---|---|---|---|---|\n| 1 | t | i | a | w |\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert responses.parse_findings(docs).count() == 1 and responses.parse_exec_summary(docs).first().critical_count == 1


def test_rules_inside_a_table_are_rows(spark):
    text = "| x |\n| a | b |\n|---|---|\n| 1 | 2 |\n|---|---|\n| 3 | 4 |\nend\n| c |\n|:-:|\n\n| d |\n|---|\n| 5 |"
    rows = responses.parse_tables(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert sorted((r.table_no, r.row_no, r.header, r.value) for r in rows) == [
        (0, 0, "a", "1"), (0, 0, "b", "2"), (0, 1, "a", "---"), (0, 1, "b", "---"), (0, 2, "a", "3"), (0, 2, "b", "4"), (1, 0, "d", "5")]


def test_long_table_does_not_exhaust_the_stack(spark):
    rows = "".join(f"| {i} | finding {i} | x | do<br>it | why |\n" for i in range(50_000))
    text = "### Critical Findings\n\n| a | b | c | d | e |\n|---|---|---|---|---|\n" + rows
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert responses.parse_findings(docs).count() == 50_000
    assert responses.parse_tables(docs).count() == 250_000


def test_sheet_findings(spark):
    text = ("intro\nFINDING 1:\nFinding: a b\nSeverity: low\nRationale: r1\nmore\n\nFINDING 2:\nFinding: c\nRecommendation: r2\n"
            "FINDING 3:\nnothing\nFINDING 4:\nFinding: d\nSeverity: HIGH\nRecommendation: old\nRationale: new")
    rows = responses.parse_sheet_findings(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("block_no").collect()
    assert [(r.severity, r.rationale) for r in rows] == [("LOW", "r1\nmore"), ("MEDIUM", "r2"), ("HIGH", "new")]
    assert rows[0].finding == "a b"


def test_prompts(spark, data):
    from palisade.workload import text_queries as t

    inputs = t.inputs(spark, data)
    rows = prompts.prompt_per_acl(*inputs).collect()
    assert len(rows) == inputs[1].count()
    for r in rows[:3]:
        assert r.chars == len(r.prompt) and r.tokens == r.chars // 4 and "{" + "rule_effectiveness}" not in r.prompt
        rules = json.loads(r.prompt.split("## Rules\n")[1].split("\n\n## Days")[0])
        hits = [x["hit_count"] for x in rules]
        assert hits == sorted(hits, reverse=True) and len(rules) <= 50
        hours = json.loads(r.prompt.split("## Hours\n")[1].split("\n\n## Countries")[0])
        assert [h["hour"] for h in hours] == sorted(h["hour"] for h in hours)
    total = sum(json.loads(r.prompt.split("## Summary\n")[1].split("\n\n## Actions")[0])["total_requests"] for r in rows)
    assert total == inputs[0].where("web_acl_id <> 'acl-retired'").count()
    legacy = {r.template: r.prompt for r in prompts.prompt_legacy(*inputs, templates=t.LEGACY, as_of="now").collect()}
    assert legacy["overview"].startswith("now 1,000/") and "{{" not in legacy["overview"]
    assert legacy["overview"].count("   - Scope: ") == inputs[1].count()
    setup, _ = json.JSONDecoder().raw_decode(legacy["setup"])
    assert len(setup) == inputs[1].count()
    for name, text in legacy.items():
        assert "{" + name not in text and "null\n" not in text
    sheets = {r.sheet: r.prompt for r in prompts.sheet_prompts(inputs[0]).collect()}
    assert set(sheets) == {"traffic", "rule_effectiveness", "geographic", "rule_action", "client"}
    assert sheets["rule_effectiveness"].count("\n- ") == 10


def test_many_small_documents_are_written_by_many_tasks(spark, tmp_path):
    docs = spark.range(64).select(F.concat(F.lit("d"), "id").alias("folder"), F.concat(F.lit("text "), "id").alias("text"))
    sinks.write_each(docs, str(tmp_path / "out"), "text", "folder")
    read = sinks.read_documents(spark, str(tmp_path / "out"))
    assert sorted((r.folder, r.value) for r in read.collect()) == sorted((f"d{n}", f"text {n}") for n in range(64))
    files = [f.name for f in (tmp_path / "out").rglob("part-*")]
    assert len(files) == 64 and len({f.split("-")[1] for f in files}) > 4


def test_long_lists_stay_out_of_the_driver(spark, data):
    """Configuration tables are put together piece by piece by the executors, and read as before."""
    from palisade.workload import text_queries as t

    logs, acls, rules, resources, logging = t.inputs(spark, data)
    _, _, texts = prompts.legacy_values(logs, acls, rules, resources, logging)
    for name in ("current_rules", "waf_config", "logging_config", "protected_resources"):
        assert isinstance(texts[name], prompts.Long)
    table = rules.select("web_acl_id", "name", "priority", "rule_type")
    order = ["web_acl_id", "priority", "name"]
    whole = spark.range(1).select(prompts.json_list(table, order).alias("x")).first().x
    before, prompts.PIECE_CHARS = prompts.PIECE_CHARS, 100
    try:
        rows, none = prompts.long_json(table, order), prompts.long_json(table.where("false"), order)
        assert rows.pieces.count() > 10
        fixed = spark.sql("SELECT * FROM VALUES ('a', 0, 0L, '<é'), ('a', 2, 0L, '|'), ('a', 4, 0L, '>'), ('b', 0, 0L, '') AS t(template, part, at, text)")
        at = lambda x, name, part: x.pieces.select(F.lit(name).alias("template"), F.lit(part).alias("part"), "at", "text")
        pieces = fixed.union(at(rows, "a", 1)).union(at(none, "a", 3)).union(at(rows, "b", 1))
        kinds = {"a": [None, rows[1:], None, none[1:], None], "b": [None, rows[1:]]}
        got = {r.template: r for r in prompts.gathered(pieces, kinds).collect()}
    finally:
        prompts.PIECE_CHARS = before
    assert got["a"].prompt == f"<é{whole}|[ ]>" and got["b"].prompt == whole
    assert all(r.chars == len(r.prompt) and r.tokens == r.chars // 4 for r in got.values())


def test_values_are_not_places(spark):
    row = spark.range(1).select(prompts.fill("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit(None)}).alias("x")).first()
    assert row.x == "{b} null {c}"


# streams
def record(i, hour, action="ALLOW"):
    return json.dumps({"timestamp": f"2024-01-01T{hour:02d}:{i % 60:02d}:00Z", "action": action, "uri": f"/{i}"})


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for f in range(4):
        (source / f"f{f}.json").write_text("\n".join(record(i, f) for i in range(20)) + "\nbroken\n")
    rows = lambda df: normalize.normalize_logs(df).select("timestamp", "action", "uri", "raw_log")
    run = lambda: st.write_available(st.stream_logs(spark, str(source), rows, 1), out, state).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 80
    run()
    assert spark.read.parquet(out).count() == 80
    (source / "late.json").write_text(record(1, 9))
    run()
    assert spark.read.parquet(out).count() == 81


def test_numbered_stream_has_no_gaps(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for f in range(3):
        (source / f"f{f}.json").write_text("\n".join(record(i, f) for i in range(30)))
    rows = lambda df: normalize.normalize_logs(df).select("timestamp", "raw_log")
    query = st.append_numbered(st.stream_logs(spark, str(source), rows, 1), str(tmp_path / "out"), str(tmp_path / "state"), ["timestamp", "raw_log"])
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.log_id for r in stored.collect()) == list(range(90)) and stored.select("batch").distinct().count() == 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    rows = lambda df: normalize.normalize_logs(df).select("timestamp", "action")

    def land(name, records):
        (source / name).write_text("\n".join(records))
        query = st.write_available(st.hourly_counts(st.stream_logs(spark, str(source), rows)), out, state)
        query.awaitTermination()
        return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]

    land("a.json", [record(i, 1, "BLOCK") for i in range(3)] + [record(0, 8)])
    progress = land("b.json", [record(1, 1), record(2, 9)])
    land("c.json", [record(1, 20)])
    hours = {r.hour.hour: (r.total_requests, r.blocked) for r in spark.read.parquet(out).collect()}
    assert hours == {1: (3, 3), 8: (1, 0), 9: (1, 0)}
    assert st.late_rows(progress) == 1


def test_config_stream_keeps_the_latest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for v in range(3):
        (source / f"v{v}.json").write_text("\n".join(json.dumps({"k": f"r{i}", "v": v, "value": f"{v}-{i}"}) for i in range(v, 5)))
    stream = spark.readStream.schema("k string, v int, value string").option("maxFilesPerTrigger", 1).json(str(source))
    st.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), "k", ["v"]).awaitTermination()
    rows = store.read(spark, str(tmp_path / "out")).collect()
    assert {r.k: r.value for r in rows} == {"r0": "0-0", "r1": "1-1", "r2": "2-2", "r3": "2-3", "r4": "2-4"}


def files_of(folder):
    return {str(f.relative_to(folder)): f.read_bytes() for f in (folder / "data").rglob("*.parquet")}


def test_merge_writes_only_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path)
    table = spark.createDataFrame([(f"k{i}", i, 0) for i in range(500)], "k string, v int, at int")
    store.merge(table, path, "k", keep_first=["at"], buckets=32)
    old = files_of(tmp_path)
    change = spark.createDataFrame([("k7", -7, 1, 0), ("k7", -8, 1, 1), ("new", 1, 1, 0)], "k string, v int, at int, position int")
    open_read = store.read(spark, path)
    assert store.merge(change, path, "k", keep_first=["at"], buckets=32, within=["position"]) == 1
    new = {n: b for n, b in files_of(tmp_path).items() if n not in old}
    assert {n.split("/")[1] for n in new} == {"_version=1"} and 1 <= len({n.split("/")[2] for n in new}) <= 2
    assert {n: b for n, b in files_of(tmp_path).items() if n in old} == old
    rows = {r.k: (r.v, r.at) for r in store.read(spark, path).collect()}
    assert len(rows) == 501 and rows["k7"] == (-8, 0) and rows["new"] == (1, 1) and rows["k8"] == (8, 0)
    assert {r.k: r.v for r in store.read(spark, path, version=0).collect()}["k7"] == 7
    # a reader that began before the change still has its files, until they are expired
    assert open_read.count() == 500 and store.expire(spark, path, keep=2) == []
    assert len(store.expire(spark, path, keep=1)) == len({n.split("/")[2] for n in new} - {None})
    assert store.read(spark, path).count() == 501 and store.versions(spark, path) == [1]


def test_a_repeated_merge_gives_the_same(spark, tmp_path):
    path, rows = str(tmp_path), [(None, 0), *[(f"k{i}", i) for i in range(40)]]
    first = spark.createDataFrame(rows, "k string, v int")
    second = spark.createDataFrame([(None, 5), ("k3", 33)], "k string, v int")
    for batch, version in ((first, 0), (second, 1), (second, 1), (second, 1)):
        store.merge(batch, path, "k", version=version, buckets=8)
    got = {r.k: r.v for r in store.read(spark, path).collect()}
    assert got == dict(rows) | {None: 5, "k3": 33} and store.versions(spark, path) == [0, 1]
    # what a write without its manifest leaves behind is not read
    (tmp_path / "data" / "_version=2" / "_part=1").mkdir(parents=True)
    assert store.versions(spark, path) == [0, 1] and store.read(spark, path).count() == 41


def test_empty_batches_and_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v int")
    store.merge(empty, str(tmp_path), "k")
    assert store.read(spark, str(tmp_path)).collect() == []
    store.merge(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path), "k")
    store.merge(empty, str(tmp_path), "k")
    assert [tuple(r) for r in store.read(spark, str(tmp_path)).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "nothing"))


def test_days_expire_without_a_rewrite(spark, tmp_path):
    path, start = str(tmp_path), datetime(2024, 1, 1)
    logs = spark.createDataFrame([(start + timedelta(hours=h), h) for h in range(240)] + [(None, -1)], "timestamp timestamp, n int")
    store.append_days(logs, path)
    more = spark.createDataFrame([(start + timedelta(days=9, minutes=1), 1000)], "timestamp timestamp, n int")
    store.append_days(more, path)
    assert store.read(spark, path).count() == 242
    before = files_of(tmp_path)
    store.retain_days(spark, path, datetime(2024, 1, 10, 12), 5)
    written = [n for n in files_of(tmp_path) if n not in before]
    assert {n.split("/")[2] for n in written} == {"_part=2024-01-05"}
    assert sorted(r.n for r in store.read(spark, path).collect()) == [-1, *range(108, 240), 1000]
    assert store.retain_days(spark, path, datetime(2024, 1, 10, 12), 0) == 2
    gone = store.expire(spark, path, keep=1)
    assert {g.rsplit("=", 1)[1] for g in gone} == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-10"}
    assert store.read(spark, path).count() == 134


def test_stream_keeps_every_record(spark, tmp_path):
    """Two objects on a line, trailing text and broken lines: the same rows and counters as
    in batch, rejects beside them, and nothing twice after a restart."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for f in range(3):
        lines = [record(i, f) for i in range(10)] + [record(10, f) + record(11, f), record(12, f) + " trailing", "broken", '{"@message":""}', "  "]
        (source / f"f{f}.json").write_text("\n".join(lines))
    rows = lambda df: normalize.normalize_logs(df).select("timestamp", "uri", "raw_log")
    run = lambda: st.land_logs(st.stream_lines(spark, str(source), 1), out, state, rows, ["timestamp", "raw_log"]).awaitTermination()
    run()
    run()
    batch = raw.decode_any(raw.scan_lines(spark, str(source)))
    key = lambda df: sorted(map(tuple, df.collect()))
    got = spark.read.parquet(f"{out}/rows")
    assert key(got.select("raw_log")) == key(raw.valid_records(batch).select("record_text")) and got.count() == 39
    assert sorted(r.log_id for r in got.collect()) == list(range(39))
    assert key(spark.read.parquet(f"{out}/rejects").select("value", "decode_status")) == key(raw.reject_rows(batch).select("value", "decode_status"))
    names = ["path", "found", "processed", "valid", "invalid", "skipped"]
    assert key(st.landed_counters(spark, out).select(*names)) == key(raw.parse_summary(batch, "path").select(*names))


def test_daily_stream_counts_clients_once_and_drops_late_rows(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    line = lambda day, hour, client, action="ALLOW": json.dumps({"timestamp": f"2024-01-{day:02d}T{hour:02d}:00:00Z", "action": action, "clientIp": client})
    rows = lambda df: normalize.normalize_logs(df).select("timestamp", "action", "client_ip")

    def land(name, lines):
        (source / name).write_text("\n".join(lines))
        query = st.write_available(st.daily_counts(st.stream_logs(spark, str(source), rows)), out, state)
        query.awaitTermination()
        return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]

    land("a.json", [line(1, 3, "x"), line(1, 4, "x", "BLOCK"), line(1, 5, "y"), line(1, 6, None)])
    land("b.json", [line(1, 23, "x"), line(1, 23, "z"), line(2, 1, "x")])
    land("c.json", [line(2, 9, "w")])
    progress = land("d.json", [line(1, 3, "late"), line(3, 4, "x")])
    land("e.json", [line(5, 4, "x")])
    days = {r.date.day: (r.total_requests, r.blocked, r.unique_ips) for r in spark.read.parquet(out).collect()}
    assert days == {1: (6, 1, 3), 2: (2, 0, 2), 3: (1, 0, 1)}
    assert st.late_rows(progress) == 1
