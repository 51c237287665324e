"""The entry points stand without the training-data operators, and without a library that these need."""

from __future__ import annotations

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ImportError(name + " is hidden")
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith("op") for n in e.queries()), "pipeline" in e.queries())
"""


def counts(*names):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=names)], cwd=TOP, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), int(out[2]), out[3] == "True"


def test_queries_without_the_subpackage():
    n, sql, own, pipeline = counts("tidemark.llm")
    assert n >= 120 and sql >= 115 and own in (0, 1) and not pipeline  # offset_self_join is the engine's


def test_queries_without_a_library():
    assert counts("xxhash")[0] == counts("tidemark.llm")[0]
    n, _, _, pipeline = counts("corpus_pipeline")
    assert n == counts("tidemark.llm")[0] + 10 or not os.path.isdir(f"{TOP}/tidemark/llm") and not pipeline
