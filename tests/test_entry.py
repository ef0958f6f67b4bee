from __future__ import annotations

import subprocess
import sys

from .conftest import ROOT

CODE = """
import sys
for name in {gone}:
    sys.modules[name] = None
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert sql <= names, sql - names
print(len(names), any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in names))
"""


def run(gone: list[str]) -> list[str]:
    done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, check=True)
    return done.stdout.split()[-2:]


def test_entry_works_without_the_subpackage():
    number, has_llm = run(["corpus_pipeline", "studyloom.llm"])
    assert int(number) > 50 and has_llm == "False"


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "index", "text", "score"] and df.count() > 0
