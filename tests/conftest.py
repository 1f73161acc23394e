import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from kinspot.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4"})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", checked(DataFrameWriter.parquet))
        yield session
    session.stop()


def checked(write):
    """Every table that is written, on the way to a result too, has a plan without a cross or nested-loop join."""

    def parquet(self, *args, **options):
        plan = self._df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan
        return write(self, *args, **options)

    return parquet


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).is_dir():
        pytest.skip("test tables are not here")
    return SF
