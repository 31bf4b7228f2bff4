"""The rest of the repository without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
{before}
import __spark_entry__ as entry
print(sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"), len(entry.queries()) == len(entry.oracle_sql()) > 50)
"""


def entry_of(root, before=""):
    script = SCRIPT.format(root=str(root), before=before)
    return subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=root).stdout


def test_entry_imports_without_both_folders(tmp_path):
    root = tmp_path / "copy"
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, root, ignore=skipped)
    assert (root / "corpus_pipeline.py").exists() == (ROOT / "corpus_pipeline.py").exists()
    assert entry_of(root) == "[] True\n"


def test_entry_imports_without_a_library_of_the_subpackage():
    assert entry_of(ROOT, "sys.modules['sentencepiece'] = None").endswith("[] True\n")


def test_nothing_else_imports_the_subpackage():
    allowed = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for source in ROOT.rglob("*.py"):
        if "llm" not in source.parts and source not in allowed and source != Path(__file__):
            assert "castlist.llm" not in source.read_text(), source
