"""The folder's queries against their SQL: python tests/llm/check_llm.py [sf folder] [name ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.join(os.path.dirname(__file__), *up) for up in (("..", ".."), ("..",))]

import oracle  # noqa: E402

from corpusloom.llm import queries  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark, con = build_session(8), oracle.connect(sf_dir)
for name in sys.argv[2:] or list(queries.QUERIES):
    start = time.time()
    if name in queries.ORACLE:
        diff, n = oracle.differences(spark, con, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    else:
        df = queries.QUERIES[name](spark, sf_dir).persist()
        diff, n = "", df.count()
        df.show(8, 100)
    print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {diff}", flush=True)
