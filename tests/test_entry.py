"""The entry points with and without the optional subpackage."""

import subprocess
import sys

SCRIPT = """
import sys
if {away}:
    sys.modules["gaugewright.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names
print(len(names), "assessment_rows" in names, any(n.startswith("op") and n[2].isdigit() for n in names))
"""


def told(away: bool) -> list[str]:
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(away=away)], capture_output=True, text=True, timeout=120, check=True)
    return done.stdout.split()


def test_queries_without_the_optional_subpackage():
    n, core, others = told(away=True)
    assert int(n) >= 30 and core == "True" and others == "False"


def test_broken_modules_are_not_hidden(tmp_path):
    script = "import sys; sys.path.insert(0, '.'); sys.modules['yaml'] = None\nimport __spark_entry__"
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert done.returncode and "yaml" in done.stderr
