import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rivulet.session import session

    conf = {
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__default__parallelism": "4",
        "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('checkpoints')}", "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")), "spark__ui__showConsoleProgress": "false",
    }
    s = session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
