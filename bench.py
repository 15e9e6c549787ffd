"""Time the headline queries and print one JSON line.

Every query runs twice over whole tables into a no-op sink; the better time counts, so JVM start-up
and first-use compilation are left out. The test tables are one small file each, which a scan can't
divide; they are first copied into as many files as there are cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tunekit.session import local_session  # noqa: E402
from tunekit_checks.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "chunk_fixed",
    "chunk_hybrid",
    "chunk_markdown",
    "text_sections",
    "code_sections",
    "html_text_regex",
    "html_text_tree",
    "json_leaves",
    "parse_documents",
    "prompt_chunk",
    "augment_column_model",
    "batch_model_infer",
    "response_explode",
    "validate_sft",
    "validate_conversation",
    "conversation_entries",
    "qc_scores",
    "qc_stats",
    "file_results",
    "roundtrip_jsonl",
    "roundtrip_csv",
    "doc_to_dataset",
]

TABLES = ["documents", "pages", "conversations", "events", "labels", "benchmark"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spread = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{spread}/{name}.parquet")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            REGISTRY[name](spark, spread).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    spark.stop()
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best of two runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
