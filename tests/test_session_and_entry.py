"""The scratch folder where none is set, and the entry without some package."""
import os
import subprocess
import sys
import warnings
from types import SimpleNamespace

from .conftest import ROOT

UNSET = """
import sys
sys.path.insert(0, sys.argv[1])
from assaykit.session import get_session, materialize, shared_dir
spark = get_session(master="local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = shared_dir(spark), shared_dir(spark)
assert one == two == spark.sparkContext.getCheckpointDir(), (one, two)
assert materialize(spark.range(7), "t").count() == 7
assert spark.range(3).checkpoint().count() == 3
print("fine")
"""


def test_folder_where_none_is_set(tmp_path):
    """In a process of its own, whose settings name no checkpoint folder."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "ASSAYKIT_DRIVER_MEMORY": "1g"}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", UNSET, ROOT], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_entry_without_the_training_data_folder(monkeypatch):
    import __spark_entry__ as entry

    def failing(name):
        def load(module):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return load

    for name, warned in (("assaykit.llm", 0), ("corpus_pipeline", 0), ("xxhash", 1)):
        monkeypatch.setattr(entry, "importlib", SimpleNamespace(import_module=failing(name)))
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always")
            names = set(entry.queries())
        assert "condition_summary" in names and not any(n.startswith("op") for n in names) and len(told) == warned
