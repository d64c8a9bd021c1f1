"""Check every query against its oracle: python tests/check_all.py [sf folder] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

import oracle  # noqa: E402

from corpusloom.plans import registry  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(registry.QUERIES)
spark, con = build_session(8), oracle.connect(sf_dir)
bad = 0
for name in names:
    start = time.time()
    try:
        diff, n = oracle.differences(spark, con, registry.QUERIES[name], registry.ORACLE[name], sf_dir)
    except Exception as error:
        text = str(error)
        diff, n = f"{type(error).__name__}: {text[:700]}", -1
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += bool(diff)
    print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {diff}", flush=True)
print(f"{len(names)} queries, {bad} differ")
