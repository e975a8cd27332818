import os
import sys
import warnings

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
warnings.filterwarnings("ignore")


@pytest.fixture(scope="session")
def spark():
    from gridspark.session import get_spark, ship

    s = get_spark("local[4]", 4, "tests", "3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
