"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from charlascope.plans.queries import registered  # noqa: E402
from charlascope.session import local_session  # noqa: E402

HEADLINES = (
    "chat_turns",
    "training_ffill",
    "row_ids",
    "no_match_cases",
    "flow_reference",
    "context_window",
    "slot_signals",
    "tfidf_vocab",
    "phrase_similarity",
    "candidate_intents",
    "candidate_evidence",
    "judge_response_parse",
    "post_validate",
    "rule_decision",
    "case_report",
    "rollup_by_flow",
    "rollup_improvements",
    "rollup_summary_lines",
    "quality_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), app="charlascope-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered(), {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
