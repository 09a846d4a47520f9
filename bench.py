"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

NAMES = (
    "purchase_list_assembly", "subtotal_reconcile", "purchase_resolution", "shipment_resolution", "top2_margin_match", "bridge_interval_directional", "bridge_interval_symmetric",
    "payment_scored_match", "event_state_fold", "shipment_upsert_merge", "hard_anchor_conflict", "audit_state_summary", "html_to_text", "rule_engine_eval", "domain_suffix_join", "frequency_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemill.plans import QUERIES

    seconds = {}
    for warm in (True, False):
        for name in NAMES if not warm else NAMES[:3]:
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if not warm:
                seconds[name] = round(time.time() - start, 3)
    found = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(found[1]) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
