"""The library and its entry module without the training-data operators."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "mi_pair_bic" in q and set(o) <= set(q)
assert "pipeline" not in q and not any(n.startswith("op") for n in q), sorted(q)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "causalnet", tmp_path / "causalnet", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from causalnet.llm import quality\n")
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
