import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ferry.session import get_session
    s = get_session("local[4]", app_name="ferry-tests",
                    conf={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture
def out(tmp_path):
    d = tmp_path / "out"
    d.mkdir()
    return str(d)


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)
    return path


def lines(path):
    with open(path.replace("file:", "")) as f:
        return f.read().splitlines()
