import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry



def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_rest_works_without_the_training_data_package():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'novelspark.llm' or name.startswith('novelspark.llm.') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and not any(n.startswith('op1') for n in e.queries())
assert len(e.queries()) > 60 and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
