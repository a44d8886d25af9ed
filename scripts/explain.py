"""Print the formatted physical plan of registered queries.

Usage: python scripts/explain.py [sf_dir] [name ...]   (default: bench headline queries)
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from clausewise.plans.registry import queries  # noqa: E402
from clausewise.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or HEADLINE
    spark = build_session("local[8]", 32)
    qs = queries()
    for name in names:
        print(f"===== {name}")
        qs[name](spark, sf_dir).explain(mode="formatted")
    spark.stop()


if __name__ == "__main__":
    main()
