import os
import shutil
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
SAMPLE = Path(__file__).parent / "fixtures" / "harbour"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def sample_repo(tmp_path):
    shutil.copytree(SAMPLE, tmp_path / "repo")
    return tmp_path / "repo"


@pytest.fixture(scope="session")
def built(spark, tmp_path_factory):
    """The sample tree, built once: (root, home, graph)."""
    from codeweave.plans.build import build_index, open_graph

    base = tmp_path_factory.mktemp("built")
    shutil.copytree(SAMPLE, base / "repo")
    build_index(spark, str(base / "repo"), str(base / "home"))
    return str(base / "repo"), str(base / "home"), open_graph(spark, str(base / "repo"), str(base / "home"))
