"""The driver's contract, with and without the removable parts."""

import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


#: Runs a query of the rest in a session of its own.
CORE = """
def run(e):
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    assert e.queries()["line_endings"](spark, "/root/testdata/sf0.001").count() == 200
"""


def test_imports_where_a_library_of_a_removable_part_is_missing():
    import os

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'line_endings' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), check=True)


def test_imports_without_removable_parts(tmp_path):
    import os
    import shutil

    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{here}/scalarium", tmp_path / "scalarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = CORE + "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries()); run(e)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
