"""What the entry offers where the optional subpackage cannot be imported."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["public_tokenizers", "pagefacts.llm.katz", "pagefacts.llm", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = e.queries()
assert "a9_site_export" in names and set(e.oracle_sql()) <= set(names)
print(len(names), any(n.startswith("op") for n in names))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    n, operators = done.stdout.split()
    assert int(n) >= 120 and (operators == "False" or missing == "corpus_pipeline")
