"""Times the headline queries and prints one JSON line.

Every query runs over the whole tables of ``$BENCH_SF_DIR`` and all of its result
is computed. The index is built first and timed on its own; the queries after it
read it, as they would in use.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusmill.plans import catalogue  # noqa: E402
from corpusmill.plans.inputs import Inputs  # noqa: E402
from corpusmill.session import local_session  # noqa: E402

HEADLINES = [
    "T6_grid_to_markdown",
    "T8_atomic_units",
    "T11_build_chunks",
    "T17_tokenize",
    "A1_visible_chunk_counts",
    "A4_can_access",
    "R1_lexical_terms",
    "R2_bm25_search",
    "R3_dense_search",
    "R6_rrf",
    "R8_rerank",
    "R13_listing_docs",
    "R18_substring_search",
    "R19_hybrid_retrieve",
    "Q2_daily_stats",
    "Q9_list_documents",
    "Q12_transcript",
    "Q13_recent_turns",
    "D1_dedup_accepted",
    "D3_dedup_chunks",
    "D11_upsert_feedback",
    "C1_reuse_exact",
    "C2_reuse_semantic",
    "C5_hot_questions",
    "C5_hot_firings",
    "C7_retain_latest",
    "E1_eval_questions",
    "E6_ablate_context",
    "M1_latency_histogram",
    "M2_latency_quantiles",
    "M7_in_flight",
    "M8_request_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}
    started = time.perf_counter()
    inputs = Inputs(spark, folder)
    inputs.chunks(), inputs.parents(), inputs.lexical(), inputs.chunk_vectors()
    times["build_index"] = round(time.perf_counter() - started, 3)

    wanted = sys.argv[1:] or HEADLINES
    for name in wanted:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
