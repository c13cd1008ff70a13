"""Headline timings as one JSON line; `BENCH_SF_DIR` and `BENCH_CPUS` set data and cores.

Every step runs once to warm up (at the same scale, so that code is compiled and files are cached)
and once for the record. Retrieval steps read an index that has been written before, as in use;
`index_build` is the time to write it.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from citadex.operators import analytics as an
from citadex.operators import corpus as co
from citadex.operators import fusion as fu
from citadex.operators import reuse as ru
from citadex.operators.dense import dense_search
from citadex.operators.lexical import bm25_search
from citadex.operators.response import respond
from citadex.plans import answering
from citadex.plans.queries import ASOF
from citadex.plans.roles import Roles
from citadex.session import get_session, scratch_path, staged
from citadex.settings import AnswerOptions
from citadex.sources.index_store import StoredIndex, read_index, write_index


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    r = Roles(spark, folder)
    paths: list[str] = []
    index: list[StoredIndex] = []

    def build() -> None:
        paths.append(scratch_path(spark, "bench-index"))
        write_index(r.nodes(), paths[-1], r.vectors())

    def load() -> None:
        index[:] = [read_index(spark, paths[-1], with_vectors=True)]

    def bm25(k: int = 10) -> DataFrame:
        return bm25_search(r.queries(), index[0].lexical, k)

    def dense(k: int = 10) -> DataFrame:
        return dense_search(r.query_vectors(), index[0].vectors, k, exclude_self=True)

    def answers() -> DataFrame:
        asked, held = answering.understand(r.query_vectors()), index[0]
        context = answering.retrieve(asked, held.nodes, held.lexical, held.vectors, AnswerOptions(), exclude_self=True)
        return respond(staged(context, "context"), asked.drop("embedding", "augmented_query"))

    steps: dict[str, Callable[[], None]] = {
        "index_build": build,
        "index_load": load,
        "bm25_topk": lambda: run(bm25()),
        "dense_topk": lambda: run(dense()),
        "hybrid_fuse": lambda: run(fu.top_k(fu.fuse(dense(20), bm25(20)), 10)),
        "answer_batch": lambda: run(answers()),
        "chunk_window": lambda: run(co.chunk_window(r.table("documents").select("doc_id", "source", "text"))),
        "page_blocks": lambda: run(co.page_blocks(r.table("pages").select("page_id", "html"))),
        "validated_build": lambda: run(ru.build_validated(r.log(), r.feedback())),
        "user_history": lambda: run(an.user_history(r.log())),
        "intent_dist": lambda: run(an.intent_distribution(r.log(), 30, ASOF)),
        "metrics_by_range": lambda: run(an.metrics_by_range(r.log(), ASOF)),
        "session_gaps": lambda: run(an.gap_sessions(r.log())),
        "recent_history": lambda: run(an.recent_history(r.log())),
    }
    seconds = {}
    for name, step in steps.items():
        step()
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    n_questions = r.queries().count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("/sf", 1)[-1], "cpus": int(cpus), "questions": n_questions,
        "ms_per_question": {k: round(1000 * seconds[k] / n_questions, 1) for k in ("bm25_topk", "dense_topk", "hybrid_fuse", "answer_batch")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
