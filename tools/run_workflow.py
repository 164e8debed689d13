"""Run the whole listing workflow on a folder of raw JSON dumps.

Usage: python tools/run_workflow.py RAW_DIR OUT_DIR [--tz America/New_York] [--small]

On a cluster, submit with your own session settings; ``spark.checkpoint.dir``
should name a shared folder (it is read from the session).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricelens.operators import ml as ML  # noqa: E402
from pricelens.plans.pipeline import run_workflow  # noqa: E402
from pricelens.session import get_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("raw_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--tz", default=None, help="zone of the raw wall-clock times, e.g. America/New_York")
    ap.add_argument("--small", action="store_true", help="small model settings (30 trees or rounds, depth 6)")
    ap.add_argument("--no-select", action="store_true", help="keep all 24 model inputs")
    a = ap.parse_args()
    spark = get_session()
    small = {"numTrees": 30, "maxIter": 30, "maxDepth": 6}
    models = {n: ML.ModelSpec(m.family, {k: min(v, small.get(k, v)) for k, v in m.params.items()}, m.weights)
              for n, m in ML.REFERENCE_MODELS.items()} if a.small else None
    paths = run_workflow(spark, a.raw_dir, a.out_dir, tz=a.tz, models=models,
                         select=None if a.no_select else 0.01)
    print(json.dumps(paths, indent=2))
    print(spark.read.text(paths["model_metrics"]).first()["value"])


if __name__ == "__main__":
    main()
