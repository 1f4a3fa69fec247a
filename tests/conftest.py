import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corvane.session import session

    folder = str(tmp_path_factory.mktemp("shared"))
    s = session("local[4]", app="tests", shuffle_partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=folder, spark__sql__warehouse__dir=folder)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
