import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tesserine.session import local_session

    return local_session(8, memory="8g")


@pytest.fixture(scope="session")
def files(spark):
    """Source files as a DataFrame from a dict of path -> content."""
    def make(contents: dict, project: str = "p"):
        return spark.createDataFrame([(project, k, v) for k, v in contents.items()], "project string, file_path string, content string")

    return make
