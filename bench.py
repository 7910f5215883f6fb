"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagestrata import plans  # noqa: E402
from pagestrata.session import local_session  # noqa: E402

HEADLINE = [
    "body_text_facts", "tokens_of", "bag_f1", "order_score", "style_agreement", "paragraph_break_f1", "run_summary", "split_pages", "merge_documents", "read_words", "ocr_filter", "page_slope",
    "line_features", "split_tabs", "join_lines", "classify_heading", "attach_borders", "merge_touching", "merge_dashes", "grid_of", "assign_cells", "cell_attributes", "apply_edits", "redact_pages", "image_usage", "reachable", "progress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cpus, shuffle=max(8, int(cpus) * 2))
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["letter_count"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
