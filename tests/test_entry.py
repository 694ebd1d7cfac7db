"""The driver contract without the operators for training data."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["sentencepiece", "public_tokenizers", "repoquarry.llm", "corpus_pipeline"])
def test_other_queries_need_none_of_its_libraries(blocked):
    code = f"""
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as entry
from repoquarry.workload import load
names = set(load()[0])
assert names and set(entry.queries()) == names == set(entry.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
