"""The library does not depend on its llm subpackage, and its entry works without it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "shelfmark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"shelfmark[. ]+(?:import )?llm", path.read_text()), path


def test_entry_without_the_subpackage(tmp_path):
    for path in ROOT.rglob("*.py"):
        relative = path.relative_to(ROOT)
        if "llm" not in relative.parts and relative.parts[0] in ("shelfmark", "__spark_entry__.py"):
            (tmp_path / relative).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / relative).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p9_found' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_every_sql_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
