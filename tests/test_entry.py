"""The entry gives the core queries whether or not the llm folder and its packages are there."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(code: str) -> set[str]:
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", f"import sys\n{code}\nimport __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"],
                         cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr[-2000:]
    return set(out.stdout.split())


def test_entry_survives_missing_packages():
    full = names("")
    core = {n for n in full if not n.startswith("op") and n != "pipeline"}
    assert "content_recommend" in core and len(core) > 100
    for module in ("public_tokenizers", "shelfwise.llm", "corpus_pipeline"):
        got = names(f"sys.modules[{module!r}] = None")
        assert core <= got, module
        assert "pipeline" not in got
