"""The driver contract, with and without the training-data package."""

import subprocess
import sys

import __spark_entry__ as entry

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("jobtide.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert not [k for k in e.queries() if k.startswith("op") or k == "pipeline"] and len(e.queries()) > 50
assert not set(e.oracle_sql()) - set(e.queries())
"""


def test_without_the_package():
    subprocess.run([sys.executable, "-c", HIDDEN], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_twins_belong_to_queries():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "queue_name" in df.columns
