"""Compare queries of this subpackage with their SQL: python -m vigilog.llm.check <dir> [name ...]"""

from __future__ import annotations

import sys
import time

from vigilog.llm.queries import QUERIES, oracle_sql
from vigilog.plans.check import compare, duck
from vigilog.session import local_session


def main(argv: list[str]) -> int:
    spark, con, checks, bad = local_session(), duck(argv[0]), oracle_sql(), 0
    for name in argv[1:] or list(QUERIES):
        start = time.time()
        df = QUERIES[name](spark, argv[0])
        note = compare(df, con, checks[name]) if name in checks else f"rows only: {df.count()}"
        bad += name in checks and note is not None
        print(f"{name} {time.time() - start:.1f}s {note or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
