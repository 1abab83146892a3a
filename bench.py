"""Time the headline queries over stored examples and answers; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the cores. Examples and answers
are derived from the tables and stored before the clock starts; rows a second count the answers that a
query reads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradelens.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402
from workload.tables import store  # noqa: E402

HEADLINES = (
    "evaluate",
    "score_generation",
    "jaccard",
    "refine_report",
    "answer_keys",
    "pick_symbol",
    "invariant_change_type",
    "invariant_location",
    "invariant_solution",
    "by_ground_truth",
    "progress",
    "change_type_prompt",
    "location_prompt",
    "solution_prompt",
    "infer_choice",
    "stream_scores",
)

BOTH = ("generations", "choices")
READS = {
    "evaluate": BOTH,
    "refine_report": ("generations",),
    "pick_symbol": ("choices",),
    "by_ground_truth": BOTH,
    "progress": BOTH,
    "stream_scores": BOTH,
}


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    smallest = Path(sf_dir).parent / "sf0.001"
    if smallest.exists():
        seconds(spark, "evaluate", str(smallest))  # start the workers and compile once
    start = time.perf_counter()
    rows = store(spark, sf_dir)
    print(f"stored {rows} in {time.perf_counter() - start:.1f} s", file=sys.stderr, flush=True)
    spent = {}
    for name in sys.argv[1:] or HEADLINES:
        spent[name] = round(seconds(spark, name, sf_dir), 3)
        read = sum(rows[kind] for kind in READS.get(name, ()))
        speed = f", {read / spent[name]:,.0f} answers a second" if read else ""
        print(f"{name}: {spent[name]} s{speed}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total wall clock",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
