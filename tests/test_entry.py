"""The driver's entry where the training-data package has been deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

from lapsewise.plans import catalog

HERE = Path(__file__).resolve().parents[1]


def test_study_queries_stay_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "oracle.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path)
    shutil.copytree(HERE / "lapsewise", tmp_path / "lapsewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    run = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True)
    n = len(catalog.REGISTRY)
    assert run.stdout.split() == [str(n), str(n), "False"]
