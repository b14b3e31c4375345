"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "flagship_contact_table",
    "x1_elements_by_tag",
    "x2_visible_text",
    "x4_anchor_links",
    "x7_emails_at_domain",
    "x8_emails_any_domain",
    "x12_inverted_index",
    "x16_profile_departments",
    "x31_page_contacts",
    "x32_page_contacts",
    "w5_best_named_per_email",
    "m2_upsert_profiles",
    "p29_robots_rules",
    "j1_contacts_with_profiles",
    "a6_coverage",
    "g2_walk_hosts",
    "g1_walk_site_capped",
    "q1_directory_contacts",
    "q2_crm_export",
    "q3_email_index",
    "q4_department_contacts_by_structure",
    "q5_department_contacts_by_walk",
    "q6_department_contacts_clean",
    "q7_curate",
    "q8_quality_report",
    "st1_first_seen_emails",
)


def main() -> None:
    from mailweave.registry import QUERIES, webs
    from mailweave.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").count().collect()  # start the executors
    webs.prepare(spark, sf_dir)  # pages are there before a query runs
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    out = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf.group(1)) if sf else None}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
