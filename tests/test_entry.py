"""The driver's entry, with and without the corpus part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lumisieve.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""


def test_it_works_without_the_corpus_part():
    out = subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 20 and int(out[1]) >= 18 and out[2] == "False"


def test_names():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_part():
    own = [p for p in (ROOT / "lumisieve").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own and not [p for p in own if "llm" in p.read_text()]
