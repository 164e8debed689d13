import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pricelens.session import get_session, ensure_checkpoint_dir
    s = get_session("local[4]", 4, app_name="pricelens-tests",
                    extra={"spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "10485760"})
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="pricelens-test-")
