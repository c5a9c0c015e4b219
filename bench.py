"""Headline queries on the driver's tables. Prints one JSON line.

The log made from lineitem is stored once as a Parquet table and rolled up once, raw JSON text made
from events and response documents made from documents are landed once; the time
of storing is reported apart. Every query then runs twice to warm up and three
times timed, into a sink that computes all columns and keeps none; the median
counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SETTINGS = {
    "spark.sql.shuffle.partitions": CPUS, "spark.default.parallelism": CPUS, "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def main() -> None:
    from palisade.operators import append, classification, inventory, metrics, normalize, rollup, sinks
    from palisade.plans import prompts, responses
    from palisade.session import build_session, scratch_path
    from palisade.sources import raw
    from palisade.workload import text_queries, views

    spark = build_session("bench", CPUS, **SETTINGS)
    spark.sparkContext.setLogLevel("ERROR")
    table = lambda make: make(spark, SF_DIR)

    start = time.perf_counter()
    stored = scratch_path(spark, "bench-logs")
    sinks.write_table(table(views.traffic).repartition(int(CPUS)), stored)
    store_seconds = round(time.perf_counter() - start, 3)
    landed, documents = scratch_path(spark, "bench-raw"), scratch_path(spark, "bench-documents")
    table(views.raw_logs).select("value").repartition(int(CPUS)).write.text(landed)
    table(text_queries.response_documents).repartition(int(CPUS)).write.parquet(documents)

    start = time.perf_counter()
    rolled_at = scratch_path(spark, "bench-rollup")
    rollup.extend(spark.read.parquet(stored), rolled_at)
    rollup_seconds, rolled = round(time.perf_counter() - start, 3), rollup.read(spark, rolled_at)

    logs, docs = spark.read.parquet(stored), spark.read.parquet(documents)
    acls, rules, resources, logging = (table(m) for m in (views.acls, views.rules, views.resources, views.logging))
    suite = {
        "summary_metrics": lambda: metrics.summary(logs),
        "action_distribution": lambda: metrics.action_distribution(logs),
        "rule_effectiveness": lambda: metrics.rule_effectiveness(logs),
        "geo_distribution": lambda: metrics.geo_distribution(logs),
        "top_blocked_ips": lambda: metrics.top_blocked_ips(logs),
        "attack_types": lambda: metrics.attack_types(logs),
        "hourly_patterns": lambda: metrics.hourly_patterns(logs),
        "daily_trends": lambda: metrics.daily_trends(logs),
        "acl_coverage": lambda: metrics.coverage(acls, logging, resources),
        "resources_by_type": lambda: metrics.resources_by_type(resources),
        "bot_counts": lambda: metrics.bot_counts(logs),
        "top_user_agents": lambda: metrics.top_user_agents(logs),
    }
    others = {
        "posture_score": lambda: classification.posture_score(logs, acls, logging, resources),
        "geo_threat_level": lambda: classification.geo_threat_level(logs),
        "traffic_per_acl": lambda: inventory.traffic_per_acl(logs, acls),
        "unused_rules": lambda: inventory.unused_rules(rules, logs),
        "acl_inventory": lambda: inventory.acl_inventory(acls, rules, resources, logging),
        "append_logs": lambda: append.append_logs(None, logs.select("timestamp", "web_acl_id", "client_ip", "terminating_rule_id", "country").distinct(),
                                                  ["timestamp", "web_acl_id", "client_ip", "terminating_rule_id", "country"]),
        "prompt_per_acl": lambda: prompts.prompt_per_acl(rolled, acls, rules, resources, logging),
        "decode_and_normalize": lambda: normalize.normalize_logs(raw.decode_lines(raw.scan_lines(spark, landed, "part-*"))),
        "parse_findings": lambda: responses.parse_findings(docs),
    }

    def run(make) -> float:
        begin = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    def median_of_three(make) -> float:
        for _ in range(2):
            run(make)
        return sorted(run(make) for _ in range(3))[1]

    seconds = {name: median_of_three(make) for name, make in {**suite, **others}.items()}
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "log_rows": logs.count(),
        "metric_suite_seconds": round(sum(seconds[n] for n in suite), 3), "store_log_table_seconds": store_seconds, "store_rollup_seconds": rollup_seconds,
        "decoded_rows_per_second": int(events / seconds["decode_and_normalize"]), "response_documents": docs.count(),
        "spark": spark.version, "settings": SETTINGS,
    }))


if __name__ == "__main__":
    sys.exit(main())
