"""Time the headline queries; prints one JSON line.

Each query runs once to warm the JVM and once timed; the timed run computes every row and drops it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parleystat.plans.queries import queries  # noqa: E402
from parleystat.session import local_session  # noqa: E402

HEADLINE = (
    "person_tokens", "analysis_frame", "condition_summary_emp", "coeffs_spec1", "coeffs_spec4", "mediation_study",
    "predictions_spec4", "session_turn_counts", "turn_numbers", "sticky_ids_text", "history_text", "history_avatar",
    "final_replies_text", "message_rows_text", "message_rows_avatar", "article_context", "url_params", "id_precedence",
    "log_export", "stream_tokens", "stream_turns_text", "stream_replay_text",
)


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="parleystat-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        timed(registered[name], spark, folder)
        seconds[name] = round(timed(registered[name], spark, folder), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
