"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the no-op sink (every row computed, nothing
collected).  Queries over n-grams make n = 1, 2, 3 in one pass.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termweave.plans import queries as Q  # noqa: E402
from termweave.session import local_session  # noqa: E402

HEADLINE = {
    "q1_top_terms": ["top_terms"],
    "q2_density": ["density"],
    "q3_gap_terms": ["gap_terms"],
    "q4_coverage": ["coverage"],
    "q5_tfidf_multi": ["tfidf_multi"],
    "q6_tfidf_ngrams": ["tfidf_ngrams"],
    "q7_tfidf_gap": ["tfidf_gap"],
    "q8_page_content": ["page_content"],
    "q9_comparison_matrix": ["comparison_matrix"],
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    # warm the JVM and the Python workers once (not timed)
    run(Q.QUERIES["word_tokens_a"](spark, "/root/testdata/sf0.001"))
    run(Q.QUERIES["page_rows"](spark, "/root/testdata/sf0.001"))
    times = {}
    for name, keys in HEADLINE.items():
        t0 = time.perf_counter()
        for k in keys:
            run(Q.QUERIES[k](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
