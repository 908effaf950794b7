"""Every query of the subpackage in a process whose Python workers cannot import the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from vigil.llm.queries import QUERIES
from vigil.session import local_session
import corpus_pipeline
spark = local_session(4, 4)
def importable(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("vigil") is not None] * b.num_rows)], names=["found"])
assert not spark.range(1).mapInArrow(importable, "found boolean").first()[0]
for name, query in [*QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("RAN", name, flush=True)
"""


def test_workers_need_no_copy_of_the_package():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tempfile.mkdtemp(), env=env, capture_output=True,
                         text=True, timeout=1500)
    ran = [x.split()[1] for x in run.stdout.splitlines() if x.startswith("RAN")]
    assert run.returncode == 0, (ran, run.stderr[-2000:])
    assert len(ran) == 14
