"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthbook.catalogue import load  # noqa: E402
from hearthbook.session import local_session  # noqa: E402

HEADLINE = [
    "relationship_strength", "contact_rollup", "merge_accounts", "first_subjects", "stratified_sample", "char_budget",
    "lookup_precedence", "address_union", "event_type_first_hit", "timeline_events", "refined_category",
    "detailed_category", "document_category", "category_share", "month_pivot", "entity_urls", "entity_profiles",
    "entity_score25", "fuzzy_name_match", "dictionary_containment", "cooccurrence_edges", "cooccurrence_skewed",
    "degree_bridge", "people_counts", "contact_score8", "chat_path_walk", "sessionize", "event_summary",
    "media_category", "directory_plan", "project_tokens", "collision_names", "hero_ranking", "leak_report",
    "broken_links", "style_fingerprint", "source_authority", "html_articles", "html_markdown", "stream_sessionize", "document_placement", "top_connectors",
    "press_links", "article_matches", "mentions", "note_lint", "html_archived",
    "contact_bundle", "graph_pipeline", "timeline_pipeline", "chat_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    registry = load()
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
