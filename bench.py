"""Wall time of the headline queries, second run; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinetable.catalog import QUERIES  # noqa: E402
from kinetable.session import local_session  # noqa: E402

HEADLINE = [
    "interpolate_missing", "visit_sequence", "transition_matrix", "walk_metric_table", "comovement", "kl_per_dim", "neighbour_ratios",
    "mutual_information", "mig", "rank_sum_auc_by_cohort", "similarity_direction_aware", "window_entropy_score", "gaussian_hmm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    out = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        for _ in range(2):
            t = time.time()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total warm wall time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
