import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from winnow.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "winnow-tests", 4)


@pytest.fixture
def hot(spark):
    """Every key with more than five rows counts as hot, so that the sliced plans run."""
    spark.conf.set("spark.winnow.hotRows", "5")
    yield spark
    spark.conf.unset("spark.winnow.hotRows")
