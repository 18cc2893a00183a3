import os

import pytest

from quillon.llm import common as C


def test_saved_tables_belong_to_the_application_and_can_be_released(spark):
    df = C.save(spark.range(5))
    home = f"{C.shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}".removeprefix("file://")
    assert df.count() == 5 and len(os.listdir(home)) >= 1
    C.release(spark)
    assert not os.path.exists(home)
    assert C.save(spark.range(3)).count() == 3 and os.path.exists(home)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        C.shared_dir(Session())
