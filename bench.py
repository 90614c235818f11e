"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wordweave.plans.catalog import REGISTRY
from wordweave.session import local_session

HEADLINE = (
    "term_frequency idf tfidf_top20 tfidf_by_source cosine_conversations line_sentiment "
    "sentiment_interval sentence_bigrams transitions flat_bigrams markov_sequential "
    "markov_min_length markov_population markov_collapse negative_generator "
    "generated_sentiment holdout_shuffled bigram_perplexity vocabulary bptt_windows"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # One small job first: starting the session is not part of a query.
    spark.read.parquet(f"{folder}/documents.parquet").agg({"doc_id": "count"}).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    result = {
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
