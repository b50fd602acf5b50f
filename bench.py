"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import time

from firmgauge import session
from firmgauge.plans import catalog

HEADLINE = (
    "sector_heatmap", "country_map", "top_movers_all", "top_movers_by_sector_bin",
    "top_movers_timeseries", "zscore_extremes", "coverage_by_agg", "coverage_by_parent",
    "coverage_compare", "ip_churn_new", "ip_churn_shifted", "ip_churn_same_parent",
    "ip_parent_switch", "stability_by_agg", "stability_weighted", "scan_findings",
    "scan_findings_all_months", "scan_enriched", "findings_on_owned_ips", "sample_companies",
    "patching_heatmap", "boxplot_by_sector", "outlier_recon_2", "outlier_recon_3",
    "outlier_flag_sector", "outlier_review_list", "outlier_change_list", "fill_rate", "email_pivot",
    "kde_by_flag", "histogram_by_sector", "corr_pearson", "corr_spearman",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = session.build("firmgauge-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.bind(catalog.QUERIES["period_window"])(spark, folder).collect()  # start-up, not timed
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.bind(catalog.QUERIES[name])(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
