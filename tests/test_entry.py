from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDE = "import sys; sys.modules['embertrail.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"


def test_entry_works_without_the_corpus_operators():
    out = subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "True"]


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_library_does_not_import_the_corpus_operators():
    for p in (ROOT / "embertrail").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
