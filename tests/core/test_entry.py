"""The entry module gives the core queries whatever is missing of the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as e
from duskwatch.plans import queries as core
assert set(core.QUERIES) <= set(e.queries()) and set(core.SQL) <= set(e.oracle_sql())
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"], e.queries().keys()
"""


def test_missing_parts_leave_the_core():
    for names in (["duskwatch.llm"], ["duskwatch.llm.queries"], ["xxhash", "corpus_pipeline"]):
        code = BLOCKED.format(names=names)
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
        assert done.returncode == 0, done.stderr[-2000:]
