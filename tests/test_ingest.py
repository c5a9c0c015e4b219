"""Decoding, splitting and normalising odd input."""

import gzip
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palisade.operators import normalize, quality
from palisade.sources import concatenated, config, events, paths, raw, tables

RECORD = {"timestamp": 1740095950321, "action": "ALLOW", "webaclId": "arn:aws:wafv2:us-east-1:1:global/webacl/example/abc",
          "httpRequest": {"clientIp": "203.0.113.1", "country": "US", "headers": [{"name": "User-Agent", "value": "Mozilla/5.0"}]}}


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")


def statuses(df):
    return [r.decode_status for r in df.orderBy("id").collect()]


def test_lines_plain_and_gzip(spark, lines):
    body = json.dumps(RECORD) + "\nbroken\n\n" + json.dumps(RECORD) + "\n"
    folder = lines({"a.json": body, "b.gz": gzip.compress(body.encode()), "c.txt": body, "empty.json": ""})
    decoded = raw.decode_lines(raw.scan_lines(spark, folder))
    assert sorted((r.path.split("/")[-1], r.found, r.valid, r.invalid) for r in raw.parse_summary(decoded, "path").collect()) == [
        ("a.json", 3, 2, 1), ("b.gz", 3, 2, 1)]
    logs = normalize.normalize_logs(decoded).collect()
    assert len(logs) == 4 and {r.web_acl_id for r in logs} == {"abc"} and {r.user_agent for r in logs} == {"Mozilla/5.0"}


@pytest.mark.parametrize("pretty", [False, True])
def test_concatenated(spark, lines, pretty):
    first, second = dict(RECORD, n=1, s='br}{ace " \\" {\\'), dict(RECORD, n=2, deep={"a": [{"b": [1, {}]}, []]})
    dump = (lambda r: json.dumps(r, indent=2)) if pretty else json.dumps
    content = {
        "same_line.json": dump(first) + dump(second),
        "spaced.json": "\n \n" + dump(first) + "  \t" + dump(second) + "\n",
        "garbage.json": dump(first) + "\nnot json at all\n" + dump(second),
        "cut.json": dump(first) + '\n{"cut": 1, "half\n' + dump(second),
        "comma.json": dump(first) + "\nends with,\n" + dump(second),
        "open.json": dump(first) + '\n{"open": {"x": 1,\n' + dump(second),
        "after.json": dump(first) + "\n, stray text\n" + dump(second),
        "shifted.json": "broken,\n  " + dump(first) + "\n{\"open\": [\n " + dump(second),
        "text.json": dump(first) + json.dumps(json.dumps(RECORD)) + "\n17\n" + dump(second),
        "empty.json": "",
    }
    folder = lines(content)
    decoded = raw.decode_any(concatenated.scan_concatenated(spark, folder))
    found = {}
    for r in raw.valid_records(decoded).select("path", F.try_variant_get("record", "$.n", "int").alias("n"), "position").collect():
        found.setdefault(r.path.split("/")[-1], []).append(r.n)
    expected = {name: [1, 2] for name in content if name != "empty.json"}
    expected["text.json"] = [1, None, 2]
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in expected.items()}


def test_nothing_after_a_value_is_lost(spark, lines):
    values = ['{"a":1}', '{"a":1}{"b":2}', '{"a":1} trailing', '{"a":1},0', '{"a":1},"x":2', '{"a":1}]', "[1]", "1,0,null", "null"]
    assert statuses(raw.decode_lines(texts(spark, values))) == ["valid"] + ["invalid"] * 8
    assert statuses(raw.decode_string_records(texts(spark, [json.dumps('{"a":1} x'), '"{}" x', '"{}"']))) == ["invalid", "invalid", "valid"]
    assert statuses(raw.decode_any(texts(spark, [json.dumps({"@message": '{"a":1}{}'}), '{"@message":"{}"} x']))) == ["invalid", "invalid"]
    folder = lines({"a.json": '{"n":1}{"n":2}\n{"n":3} trailing\n{"n":4}\n', "b.log": '{"n":1}\n, junk,\n{"n":2}\nx {"n":3}\n'})
    found = raw.parse_summary(raw.decode_lines(raw.scan_lines(spark, folder, "a.json"))).first()
    assert (found.found, found.valid, found.invalid) == (5, 4, 1)
    cut = raw.decode_any(concatenated.scan_concatenated(spark, folder, "b.log"))
    assert sorted(r.value for r in raw.reject_rows(cut).collect()) == [", junk,", 'x {"n":3}']
    assert raw.valid_records(cut).count() == 2


def test_broken_text_takes_linear_time(spark, lines):
    folder = lines({"bad.log": "{ broken,\n" * 20000 + "ends with ,\n" * 20000, "deep.log": '{"a": [\n' * 20000 + "[\n" * 20000 + "]\n" * 10})
    read = concatenated.scan_concatenated(spark, folder).groupBy("path").agg(F.sum(F.length("value")).alias("n"), F.max(F.length("value")).alias("longest"))
    found = {r.path.split("/")[-1]: (r.n, r.longest) for r in read.collect()}
    # no line of broken text is lost, and none is gathered with another; the ten innermost
    # lists of the second file are closed and stand on 20 lines
    assert found == {"bad.log": (20000 * 9 + 20000 * 11, 11), "deep.log": (20000 * 7 + 20000 + 10 + 19, 39)}


def resumed(text):
    """All objects and lists of a text as a reader gives them that goes on behind a value,
    and at the next line where there is none."""
    reader, at, out = json.JSONDecoder(), 0, []
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        try:
            value, at = reader.raw_decode(text, at)
            out += [value] if isinstance(value, (dict, list)) else []
        except ValueError:
            following = text.find("\n", at)
            at = len(text) if following < 0 else following + 1
    return out


def test_values_in_any_broken_text(spark, lines):
    """Values between, inside and behind random broken lines, of every indentation, are all
    found; a file read in small blocks gives the same."""
    rng = random.Random(11)
    junk = ['{"open": {"x": 1,', "{", "[", "]", "},", '{"a" 1}', '["x": 1]', '{"cut": "abc', "null,", ", x", "{ [", '"key":', '{"k": [1, 2', "]]", '[{"q": 1},', "}"]
    content = {}
    for f in range(12):
        text = ""
        for n in range(40):
            value = {"n": 1000 * f + n, "s": '}{ "\\', "deep": [{"b": [1, {}]}, [], -1.5e3, True, None]}
            dumped = json.dumps(value, indent=rng.choice([None, None, 1, 4]))
            pad = " " * rng.randrange(6)
            text += "".join(pad + line + "\n" for line in dumped.split("\n"))
            text += "".join(" " * rng.randrange(6) + rng.choice(junk) + "\n" for _ in range(rng.choice([0, 0, 1, 3])))
        content[f"f{f}.log"] = text
    folder = lines(content)
    own = lambda values: sorted(v["n"] for v in values if isinstance(v, dict) and "n" in v)

    def found():
        rows = raw.valid_records(raw.decode_lines(concatenated.scan_concatenated(spark, folder)))
        return sorted(r.n for r in rows.select(F.try_variant_get("record", "$.n", "int").alias("n")).where("n is not null").collect())

    want = own(v for text in content.values() for v in resumed(text))
    assert found() == want and len(want) > 300
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert found() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_braces_in_strings_cut_nothing(spark):
    """Lines whose strings look like seams stay whole and skip the slow cutter."""
    values = ['{"s": "} x {", "t": "a\\\\"}', '{"s": "\\"} x"}', '{"s":"} {"}{"n":"} x"}', '{"open": "} x', '{"a":1} "} x"']
    cut = texts(spark, values).select(raw.value_pieces(F.col("value")).alias("p")).collect()
    assert [len(r.p) for r in cut] == [1, 1, 2, 1, 2]


def test_concatenated_reads_once(spark, lines):
    folder = lines({"a.log": '{"n":\n1}\n{"n":2}\n'})
    values = concatenated.scan_concatenated(spark, folder)
    assert values.count() == 2
    rows = values._jdf.queryExecution()
    values.collect()
    plan = rows.executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan text") == 1 or "ReusedExchange" in plan


def test_concatenated_over_many_blocks(spark, lines):
    """A file cut into small blocks gives the same values as one read whole."""
    records = [dict(RECORD, n=i, pad="x" * (i % 50)) for i in range(400)]
    text = "".join(json.dumps(r, indent=1) + ("" if i % 3 else "\n") for i, r in enumerate(records))
    folder = lines({"big.json": text})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        values = concatenated.scan_concatenated(spark, folder)
        assert spark.read.text(folder).select(F.countDistinct("_metadata.file_block_start")).first()[0] > 5
        got = [json.loads(r.value)["n"] for r in values.orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(400))


def test_concatenated_shuffles_values_once(spark, lines):
    """Lines are read where they are: one exchange, of values, and nothing is gathered behind it."""
    folder = lines({"a.log": "".join(json.dumps({"n": n, "l": [n]}, indent=1) + "\n" for n in range(300))})
    values = concatenated.scan_concatenated(spark, folder)
    plan = values._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") + plan.count("Exchange") == 1
    opened = concatenated.units(spark, folder, "*.log").mapInArrow(concatenated.read_blocks, "path string, spread int, place bigint, position bigint, flags int, text string")
    assert opened.where("place is null").count() == 300 and opened.where("place is not null").count() == 1


def test_open_lines_wait_in_a_file():
    held = concatenated.Held()
    units = [(n, n % 4, f"é {n} " + "x" * 1000) for n in range(2 * concatenated.HELD_CHARS // 1000)]
    for unit in units:
        held.add(*unit)
    assert held.file is not None and len(held.units) < len(units) and list(held.take()) == units and not held


def test_packed_concatenation_is_small(spark, data):
    """The files of the query are packed but for one record in ten."""
    import glob
    import os

    from palisade.session import shared_dir
    from palisade.workload import all_queries
    from palisade.workload import views as v

    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/concat-*"))
    rows = all_queries()["scan_concat_json"](spark, data).count()
    written = sum(os.path.getsize(f) for d in set(glob.glob(f"{root}/concat-*")) - before for f in glob.glob(f"{d}/part-*"))
    texts = v.raw_logs(spark, data).agg(F.count("value").alias("n"), F.sum(F.length("value")).alias("chars")).first()
    assert rows == texts.n and written < texts.chars / 3


def test_indented_fast_path(spark, lines):
    text = "".join(json.dumps(dict(RECORD, n=i), indent=2) + "\n" for i in range(3))
    folder = lines({"a.json": text, "b.json.gz": gzip.compress(text.encode())})
    decoded = raw.decode_lines(raw.scan_indented(spark, folder))
    assert [r.decode_status for r in decoded.collect()] == ["valid"] * 6


def test_exports(spark):
    inner = json.dumps(RECORD)
    values = [
        json.dumps({"@message": inner, "@ptr": "p", "@timestamp": "2025-02-20 23:59:10.321"}), json.dumps({"@message": {"a": 1}}),
        json.dumps({"@message": "{broken"}), json.dumps({"@message": ""}), json.dumps({"other": 1}), "[1]", json.dumps({"@message": "[1]"}),
    ]
    decoded = raw.decode_exports(texts(spark, values))
    assert statuses(decoded) == ["valid", "invalid", "invalid", "skipped", "invalid", "invalid", "invalid"]
    row = decoded.where("id = 0").first()
    assert (row.export_ptr, row.export_time, row.source) == ("p", "2025-02-20 23:59:10.321", "cloudwatch_export")


def test_events(spark):
    inner = json.dumps(RECORD)
    values = [json.dumps(v) for v in (
        {"message": inner, "eventId": "e1", "ingestionTime": 5}, {"Message": RECORD}, {"@message": "", "message": inner}, {"message": 3}, {"x": 1}, {"message": "nope"})]
    decoded = raw.decode_events(texts(spark, values))
    assert statuses(decoded) == ["valid", "valid", "valid", "invalid", "skipped", "invalid"]
    assert decoded.where("id = 0").select("event_id", "ingestion_time").first() == ("e1", 5)


def test_strings(spark):
    decoded = raw.decode_string_records(texts(spark, [json.dumps(json.dumps(RECORD)), '"[1]"', '"x"', "17", "{}"]))
    assert statuses(decoded) == ["valid", "invalid", "invalid", "invalid", "invalid"]


def test_found_is_the_sum(spark):
    values = [json.dumps(RECORD), "x", "", '"{}"', '{"@message":""}', '{"@message":3}', "5", "null", '{"@message":"{}"}']
    row = raw.parse_summary(raw.decode_any(texts(spark, values))).first()
    assert row.found == row.valid + row.invalid + row.skipped == len(values)
    assert raw.reject_rows(raw.decode_any(texts(spark, values))).count() == row.invalid + row.skipped


def normalized(spark, *records):
    decoded = raw.decode_lines(texts(spark, [json.dumps(r) for r in records]))
    return normalize.normalize_logs(decoded).collect()


def test_timestamps(spark):
    utc = lambda t: datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)
    cases = [(10_000_000_000, utc(10_000_000_000)), (10_000_000_001, utc(10_000_000.001)), (0, None), ("2025-01-01T00:00:00", datetime(2025, 1, 1)),
             ("2025-01-01T07:00:00+07:00", datetime(2025, 1, 1)), ("nope", None), (None, None), ("12:30", None), ("T12:30", None), ("20240101T120000Z", datetime(2024, 1, 1, 12)), ("20240101T1230+0100", datetime(2024, 1, 1, 11, 30)), (1740095950321, utc(1740095950.321))]
    rows = normalized(spark, *[{"timestamp": t, "action": "ALLOW"} for t, _ in cases])
    assert [r.timestamp for r in rows] == [want for _, want in cases]


def test_fallbacks(spark):
    rows = normalized(
        spark,
        {"action": "", "webaclId": "bare", "httpRequest": {"clientIp": "", "headers": [{"name": "X"}, {"name": "USER-AGENT", "value": "one"}, {"name": "user-agent", "value": "two"}]}, "clientIp": "1.2.3.4"},
        {"action": "EXCLUDED", "webAclId": "arn:aws:wafv2:r:1:regional/webacl/n/id", "country": "-"},
        {"httpRequest": {"headers": [{"name": "user-agent"}]}, "ruleGroupList": [{"ruleGroupId": "g"}, {"ruleGroupName": "n"}, {}], "terminatingRuleMatchDetails": [{"x": 1}]},
        {"httpRequest": None, "httpStatus": 200},
    )
    assert [(r.action, r.web_acl_id, r.client_ip, r.country, r.user_agent) for r in rows] == [
        ("UNKNOWN", "bare", "1.2.3.4", None, "one"), ("EXCLUDED", "id", None, "-", None), ("UNKNOWN", None, None, None, None), ("UNKNOWN", None, None, None, None)]
    assert rows[3].http_status == 200
    assert json.loads(rows[0].raw_log)["clientIp"] == "1.2.3.4"


def test_nested_json_text(spark):
    decoded = raw.decode_lines(texts(spark, ['{"labels":[{"name":"a"}],"terminatingRuleMatchDetails":[{"b":1}]}', "{}"]))
    rows = normalize.nested_to_json(normalize.normalize_logs(decoded)).collect()
    assert [(r.labels, r.rate_based_rule_list, r.request_headers, r.terminating_rule_match_details) for r in rows] == [
        ('[{"name":"a"}]', "[]", "[]", '[{"b":1}]'), ("[]", "[]", "[]", None)]


def test_rejects_without_time(spark):
    decoded = raw.decode_lines(texts(spark, [json.dumps(RECORD), "{}"]))
    good, bad = normalize.split_rejects(normalize.normalize_logs(decoded))
    assert (good.count(), bad.count()) == (1, 1)
    filled = normalize.normalize_logs(decoded, F.lit(datetime(2020, 1, 1)).cast("timestamp"))
    assert filled.where("timestamp is null").count() == 0


def test_validation_of_records(spark):
    full = {"timestamp": 1, "action": "BLOCK", "clientIp": "a", "country": "b", "uri": "c", "httpMethod": "d", "httpVersion": "e", "httpStatus": 0}
    decoded = raw.decode_lines(texts(spark, [json.dumps(full), json.dumps(dict(full, uri=None, action="ODD")), "{}"]))
    checked = quality.validate_logs(decoded, quality.required_of_record(), F.try_variant_get("record", "$.action", "string"))
    assert [(r.is_valid, r.reasons) for r in checked.orderBy("id").limit(2).collect()] == [(True, ""), (False, "missing:uri;invalid:action")]
    dotted = quality.required_of_record(["httpRequest.clientIp"])
    assert raw.decode_lines(texts(spark, ['{"httpRequest":{"clientIp":""}}'])).where(list(dotted.values())[0].isNull()).count() == 1


def test_paths(spark):
    keys = ["AWSLogs/1/acl/2024/12/02/01/05/1_waflogs_r_acl_20241202T0105Z_ab.log.gz", "AWSLogs/1/acl/nodate/file.json", "x/2024/13/40/99/f.gz"]
    df = spark.createDataFrame([(k,) for k in keys], "path string")
    got = df.select(paths.file_time_from_path("path"), paths.file_time_from_name("path"), paths.base_prefix_from_key("path"), paths.is_log_file("path")).collect()
    assert [tuple(r) for r in got] == [
        (datetime(2024, 12, 2, 1), datetime(2024, 12, 2, 1, 5), "AWSLogs/1/acl/", True), (None, None, "", True), (None, None, "x/", True)]


def test_range_includes_the_starting_hour(spark):
    files = spark.createDataFrame([(f"a/2024/01/01/{h:02d}/f.gz",) for h in range(5)], "path string")
    inside = paths.files_in_range(files, datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 3, 0))
    assert sorted(r.path[13:15] for r in inside.collect()) == ["01", "02", "03"]


def test_listing_reads_no_content(spark, lines):
    folder = lines({"a.gz": "1234", "b.json": "12", "c.txt": "1"})
    listing = paths.list_files(spark, folder)
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert sorted(r.length for r in paths.log_files(listing).collect()) == [2, 4]


def test_common_prefix_without_dates(spark):
    keys = spark.createDataFrame([("g", "logs/app/one.gz"), ("g", "logs/app/other.gz"), ("h", "solo/2024/01/f.gz")], "g string, path string")
    assert {r.g: r.base_prefix for r in paths.base_prefix(keys, "g").collect()} == {"g": "logs/app/o/", "h": "solo/"}


def test_chunks_are_half_open_and_clipped(spark):
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 10)
    logs = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(12)], "timestamp timestamp")
    got = events.time_chunks(logs, start, end, 6).groupBy("chunk", "chunk_end").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, datetime(2024, 1, 1, 6), 6), (1, end, 4)]


def test_empty_sample(spark):
    nothing = spark.createDataFrame([], "message string, timestamp timestamp, id int")
    streams = spark.createDataFrame([(100,)], "stored_bytes bigint")
    row = events.estimate_volume(nothing, streams, ["timestamp"]).first()
    assert (row.estimated_events, row.estimated_bytes, row.sample_size) == (0, 0, 0)


def test_acl_config(spark, lines):
    dump = {"Id": "a", "Name": "n", "DefaultAction": {"Allow": {}}, "Rules": [
        {"Name": "r1", "Priority": 1, "Action": {"Block": {}}, "Statement": {"ManagedRuleGroupStatement": {"VendorName": "V", "Name": "G", "Version": "1"}}},
        {"Name": "r2", "Priority": 2, "Statement": {"AndStatement": {}}}, {"Name": "r3", "Statement": {"SomethingElse": 1}}]}
    folder = lines({"acl.json": json.dumps(dump, separators=(",", ":"))})
    rules = config.extract_rules(config.scan_acl_config(spark, folder, "REGIONAL")).orderBy("position").collect()
    assert [(r.name, r.rule_type, r.vendor_name, r.action) for r in rules] == [
        ("r1", "MANAGED_RULE_GROUP", "V", '{"Block":{}}'), ("r2", "LOGICAL", None, "{}"), ("r3", "CUSTOM", None, "{}")]


def test_dedup_and_union(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "value string")
    assert tables.drop_duplicate_records(a).count() == 2
    assert tables.union_sources({"one": a, "two": a.withColumn("more", F.lit(1))}).count() == 6
