"""Time the headline queries; prints one JSON line.

Each query runs once at ``$BENCH_SF_DIR`` and its whole result is consumed.
Shared inputs (index tables, ranked lists) are made by the entries named
``build_*`` and ``retrieve_*``, and timed there. A pass over the smallest
test folder warms the JVM first and is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.data import test_data
from checks.queries import QUERIES
from kinspot.plans import detectors as dt
from kinspot.plans import evaluation as pe
from kinspot.session import local_session

SHARED = {
    "build_indexes": lambda d: d.index,
    "retrieve_dense": lambda d: d.dense,
    "retrieve_sparse": lambda d: d.sparse,
    "retrieve_hybrid": lambda d: d.hybrid,
    "retrieve_neighbours": lambda d: d.neighbours,
    "build_cases": lambda d: d.cases,
    "build_segments": lambda d: d.segments,
    "build_commands": lambda d: d.commands,
    "build_replay": lambda d: d.replayed,
}
END_TO_END = {
    "full_evaluation_with_retrieval": lambda d: pe.report(pe.full_evaluation(d.index, d.queries, d.cases)),
}
DETECTORS = {
    "embedding": lambda d: dt.detect_threshold(d.queries, dt.dense_hits(d.index, d.queries, 5)),
    "sampled_context": lambda d: dt.detect_sampled_context(d.index, d.queries, n=100),
    "dense_context": lambda d: dt.detect_dense_context(d.index, d.queries),
    "hybrid_context": lambda d: dt.detect_hybrid_context(d.index, d.queries),
}
HEADLINE = [
    "tokenize_text", "token_band_filter", "hash_embed", "extract_functions_from_modules", "bm25_rescore_pairs",
    "sparse_topk_thresholds", "hybrid_rrf_topk", "max_similarity_to_corpus", "detect_threshold",
    "build_judge_prompts", "token_jaccard_pairs", "validate_positive", "validate_negative",
    "first_valid_candidate", "full_evaluation", "rebuild_indexes", "sweep_k", "sweep_rrf_k", "error_report",
    "replay_statuses", "replay_final_table", "replay_asof_lookup", "replay_asof_snapshot",
    "apply_adds", "point_lookups", "assemble_transcripts", "pair_tool_calls",
    "sparse_topk_blocks",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def run(spark, sf_dir: str) -> tuple[dict[str, float], dict[str, float]]:
    data = test_data(spark, sf_dir)
    seconds = {name: timed(lambda: make(data)) for name, make in SHARED.items()}
    n_cases = data.queries.count()
    per_case = {}
    for name, detect in DETECTORS.items():
        seconds[f"detect_{name}"] = timed(lambda: consume(detect(data)))
        per_case[name] = round(seconds[f"detect_{name}"] / n_cases, 5)
    for name, evaluate in END_TO_END.items():
        seconds[name] = timed(lambda: consume(evaluate(data)))
    for name in HEADLINE:
        seconds[name] = timed(lambda: consume(QUERIES[name](spark, sf_dir)))
    return seconds, per_case


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    warm = Path(sf_dir).parent / "sf0.001"
    if warm.is_dir() and str(warm) != sf_dir:
        run(spark, str(warm))
    seconds, per_case = run(spark, sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "seconds_per_case": per_case,
    }))


if __name__ == "__main__":
    main()
