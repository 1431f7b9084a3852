"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodeseek.plans import registry  # noqa: E402
from lodeseek.runtime import build_session, drop_stages  # noqa: E402

HEADLINE = (
    "bm25_corpus_stats", "bm25_topk", "vector_topk_batch", "mmr_select", "rrf_fusion", "hybrid_retrieve",
    "text_embedding", "manifest_diff", "chunk_sequence", "text_chunks", "code_chunks", "entity_normalize",
    "graph_integrity", "one_hop_expand", "communities", "graph_hybrid", "merge_candidates", "search_answers",
    "web_extract", "video_rank", "ndcg_by_type", "sse_tokenize", "sse_fold",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so that session start is not counted against the first query.
    registry.table(spark, sf_dir, "region").count()
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    drop_stages(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
