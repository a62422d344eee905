"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs in full into a no-op sink. Writing the derived relations is timed on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "secured_view", "rows_visible_per_principal", "access_grants", "row_filter_statements", "column_mask_statements",
    "tag_grants", "tag_statements", "translate_all", "normalise_access_items", "validate_access_items",
    "validation_verdict", "apply_outcomes_strict", "daily_application_summary", "mask_hash",
]


def main() -> int:
    from palisade.plans import audit_queries, catalog, document_queries, fixtures as fx
    from palisade.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    fx.inputs(spark, sf_dir), fx.mapping(spark, sf_dir), fx.documents(spark, sf_dir), fx.validation_documents(spark, sf_dir)
    document_queries._policies(spark, sf_dir), audit_queries.document_tables(spark, sf_dir)
    times["stage_relations"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
