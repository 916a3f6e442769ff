"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigrid.operators import encode  # noqa: E402
from lexigrid.plans import all_queries, tables  # noqa: E402
from lexigrid.session import local_session, release  # noqa: E402

HEADLINE = (
    "nearest_label_centroid knn_topk knn_neighbours pairs_above components_of_similar star_clusters avg_sim_roles ann_join "
    "enum_build enum_containment enum_batch_probe unrecognised_names set_bitmap_store value_levels "
    "normalize_terms token_stats doc_windows pack_sequences encode_docs window_pool "
    "target_tables table_text table_similarity table_match type_mix snapshot_drift year_templates unpivot_recipe unpivot_apply "
    "column_roles tight_pairs table_profile topic_profile coarse_match "
    "hierarchy_paths place_text column_levels resolve_rows resolve_sieve "
    "model_predictions model_accuracy model_spread pair_grid").split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cpus=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), shuffle_partitions=int(cpus))
    queries = all_queries()
    # start the Python workers and the first code generation outside the measurement
    encode.encode(tables.documents(spark, folder).limit(100), "text").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release()
        print(name, seconds[name], file=sys.stderr, flush=True)
    docs = tables.documents(spark, folder)
    n = docs.count()
    rates = {}
    for encoder in encode.DEFAULT_ENCODERS.values():
        start = time.perf_counter()
        encode.encode(docs.select("text"), "text", encoder).select("vec").write.format("noop").mode("overwrite").save()
        rates[encoder.name] = round(n / (time.perf_counter() - start), 1)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "texts_per_sec": rates, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
