"""Python workers can import the package wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from tidemark.session import local_session
spark = local_session(2, 4)
for name in ("s11_article_titles", "a11_linregress_full", "p15_trend_line", "a16_kde_items"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
"""


def test_queries_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_checkpoint_folder_off_local():
    import pytest
    from tidemark import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())
