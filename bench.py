"""Time the registered queries: prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores; BENCH_QUERIES (comma-separated) narrows the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans import registry  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

HEADLINE = [
    "src_jsonl_gz", "ingest_first_wins", "match_by_content_upsert", "uuid5_key", "task_prompt_filter", "code_like_filter",
    "role_to_sharegpt", "translation_pairs", "cache_apply_all_or_nothing", "translation_gate", "refusal_filter",
    "token_ratio_bands", "dsir_ngram_features", "dsir_importance_weights", "dsir_resample", "per_source_cap",
    "head_fraction", "mixture_build", "fmt_passage_spans", "tokenizer_efficiency", "vocab_size", "vocab_train_topk",
    "bpe_merge_rounds", "vocab_merge_rules", "sft_encode", "score_rollup", "impute_column_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="corpusloom-bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
