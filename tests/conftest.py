import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from quireworks.session import build

    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build(
        "local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"{place}/shared",
        spark__sql__warehouse__dir=f"{place}/warehouse",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
