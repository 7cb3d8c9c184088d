import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    base = tmp_path_factory.mktemp("spark")
    spark = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__sql__warehouse__dir=str(base / "warehouse"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"file://{base}/shared")
    yield spark
    spark.stop()
