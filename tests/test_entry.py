"""The entry points without the optional training-data part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

HIDE = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "pncounter_value" in names and not any(n.startswith("op1_") for n in names)
assert set(entry.oracle_sql()) <= names
"""


def run(*names):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=names)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_without_the_subpackage():
    """The folder and corpus_pipeline.py are gone."""
    run("tideweave.llm", "corpus_pipeline")


def test_without_what_it_needs():
    for name in ("ahocorasick", "xxhash", "zstandard", "public_tokenizers"):
        run(name)
