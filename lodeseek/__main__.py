"""Command line: ``python -m lodeseek code-index|graph-index|evaluate|query ...``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from lodeseek.config import EXCLUDED_GLOBS, Tunables
from lodeseek.runtime import build_session, delete_path, drop_stages, path_exists


def _now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodeseek")
    sub = top.add_subparsers(dest="command", required=True)
    code = sub.add_parser("code-index")
    code.add_argument("base")
    code.add_argument("store")
    code.add_argument("--full", action="store_true")
    code.add_argument("--limit", type=int)
    code.add_argument("--dry-run", action="store_true")
    code.add_argument("--exclude", action="append", default=[])
    code.add_argument("--sample-query", action="append", default=[])
    code.add_argument("--sample-only", action="store_true")
    code.add_argument("--top-k", type=int, default=5)
    graph = sub.add_parser("graph-index")
    graph.add_argument("folder")
    graph.add_argument("store")
    graph.add_argument("--reset", action="store_true")
    graph.add_argument("--limit-chapters", type=int)
    graph.add_argument("--max-chunks", type=int)
    graph.add_argument("--no-vector", action="store_true")
    graph.add_argument("--skip-community", action="store_true")
    graph.add_argument("--retry-failed", action="store_true")
    evaluate = sub.add_parser("evaluate")
    evaluate.add_argument("kind", choices=["code", "graph"])
    evaluate.add_argument("items")
    evaluate.add_argument("store")
    evaluate.add_argument("samples")
    evaluate.add_argument("--limit", type=int)
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("sf_dir")
    return top


def main(argv: list[str] | None = None) -> int:
    args, cfg = _parser().parse_args(argv), Tunables().with_env()
    spark = build_session("lodeseek")
    try:
        return globals()[f"_{args.command.replace('-', '_')}"](spark, args, cfg)
    finally:
        drop_stages(spark)


def _code_index(spark, args, cfg) -> int:
    from lodeseek.plans.code_index import run_dry, run_index, sample_search

    if args.dry_run:
        run_dry(spark, args.base, args.store, _now(), args.limit, cfg).show(vertical=True, truncate=False)
        return 0
    if not args.sample_only:
        run_index(spark, args.base, args.store, _now(), full=args.full, limit=args.limit,
                  globs=(*EXCLUDED_GLOBS, *args.exclude), cfg=cfg).show(vertical=True, truncate=False)
    if args.sample_query:
        asked = spark.createDataFrame(list(enumerate(args.sample_query)), "query_id long, query string")
        sample_search(spark, args.store, asked, args.top_k).orderBy("query_id", "rank").show(truncate=False)
    return 0


def _graph_index(spark, args, cfg) -> int:
    from lodeseek.plans.graph_index import run_graph_index

    run = run_graph_index(
        spark, args.folder, args.store, reset=args.reset, retry_failed=args.retry_failed,
        limit_docs=args.limit_chapters, max_chunks=args.max_chunks, skip_community=args.skip_community,
        vectors=not args.no_vector, cfg=cfg)
    run.stats.show(vertical=True, truncate=False)
    return 0 if run.stats.first()["integrity_ok"] else 1


def _evaluate(spark, args, cfg) -> int:
    from lodeseek.plans import evaluation as E
    from lodeseek.plans.graph_index import load_saved
    from lodeseek.sources.files import CODE_ITEM, GRAPH_ITEM, json_lines
    from lodeseek.sources.tables import code_store

    if path_exists(spark, args.samples):
        delete_path(spark, args.samples)
    if args.kind == "code":
        items, retrieve = json_lines(spark, args.items, CODE_ITEM), E.code_contexts(code_store(spark, args.store).read("code_chunks"), cfg=cfg)
    else:
        items, retrieve = json_lines(spark, args.items, GRAPH_ITEM), E.graph_contexts(load_saved(spark, args.store), cfg=cfg)
    for frame in E.evaluate(spark, items, args.kind, retrieve, args.samples, limit=args.limit, cfg=cfg).values():
        frame.show(truncate=False)
    return 0


def _query(spark, args, cfg) -> int:
    from lodeseek.plans import registry

    registry.load_all()
    registry.QUERIES[args.name](spark, args.sf_dir).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
