"""Time the headline queries: one warm-up, then the median of the timed runs, each run to the end.

The given tables are single files of one row group, which one core would read alone.  They are first laid out in several
files, as tables of a cluster are; that is not timed.  Times are printed as each query ends.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma list or ``all``) override the defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_entities", "mention_facts", "share_of_voice_answers", "excerpts", "match_domains",
    "mention_share", "appearance_rank", "share_of_voice", "entity_trends", "entity_model_trends",
    "item_history", "compare_dates", "trend_by_regression", "extract_links", "classify_links",
    "rollup_link_types", "rollup_link_domains", "carry_forward", "complete_dates", "merge_questions",
    "entity_view", "competitors", "items_per_model", "answer_sources", "answers_with_citations",
    "answer_context", "annotate_text", "audit_score",
]


#: Tables smaller than this stay one file.
SMALL = 1 << 20
#: A query whose warm-up takes longer than this many seconds is timed once.
LONG = 30


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables with the larger ones in several files, rows dealt out evenly."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, name)
        if name.endswith(".parquet"):
            large = os.path.isfile(path) and os.path.getsize(path) >= SMALL
            if large:
                spark.read.parquet(path).repartition(files).write.parquet(os.path.join(folder, name))
            else:
                os.symlink(path, os.path.join(folder, name))
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")

    from answerlens.catalog import QUERIES
    from answerlens.session import get_session

    spark = get_session(f"local[{cpus}]", app="bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    times: dict[str, float] = {}
    tables = laid_out(spark, sf_dir, 2 * int(cpus))
    for name in names:
        taken = []
        for k in range(runs + 1):
            if k > 1 and taken[0] > LONG:
                break
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "answerlens headline queries, total of medians", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
