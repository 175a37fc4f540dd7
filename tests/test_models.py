"""Models saved in one session and loaded in another give equal scores."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from quietgrid import models as M

ROOT = str(Path(__file__).resolve().parents[1])


def rows(spark, n=240):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2)) * [1, 2] + np.where(np.arange(n) % 3, 0, 4)[:, None]
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, cell int, f array<double>")


ESTIMATORS = {
    "background": (M.BackgroundEstimator(dim=2), ["rem", "frx_global", "frx_cell", "frx_bayes"]),
    "universal": (M.UniversalMixtureEstimator(idCols=["id"], components=2), ["ubm"]),
    "dirichlet": (M.DirichletMixtureEstimator(idCols=["id"], components=4, rounds=5), ["density"]),
    "skewed": (M.SkewedBackgroundEstimator(idCols=["id"], rounds=2), ["skew_t"]),
    "network": (M.ReconstructorEstimator(idCols=["id"], dim=2, components=1, rounds=3), ["residual"]),
}
_LOAD = """
import sys
from pyspark.sql import SparkSession
from quietgrid import models
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name, kind in (a.split("=") for a in sys.argv[2:]):
    root = sys.argv[1]
    getattr(models, kind).load(f"{root}/{name}").transform(spark.read.parquet(f"{root}/rows")).write.parquet(f"{root}/scored-{name}")
"""


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    df = rows(spark)
    df.write.parquet(str(root / "rows"))
    own = {}
    for name, (estimator, _) in ESTIMATORS.items():
        model = estimator.fit(df)
        model.write().overwrite().save(str(root / name))
        own[name] = {r["id"]: r for r in model.transform(df).collect()}
    kinds = [f"{n}={type(e).model.__name__}" for n, (e, _) in ESTIMATORS.items()]
    subprocess.run([sys.executable, "-c", _LOAD, str(root), *kinds], check=True, cwd=root, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, timeout=300)
    return root, own


@pytest.mark.parametrize("name", sorted(ESTIMATORS))
def test_another_session_scores_alike(spark, saved, name):
    root, own = saved
    got = {r["id"]: r for r in spark.read.parquet(str(root / f"scored-{name}")).collect()}
    assert got.keys() == own[name].keys() and len(got) == 240
    for column in ESTIMATORS[name][1]:
        np.testing.assert_allclose([got[i][column] for i in got], [own[name][i][column] for i in got], rtol=1e-12)


def test_a_model_of_another_kind_is_refused(saved):
    with pytest.raises(ValueError, match="BackgroundModel"):
        M.SkewedBackgroundModel.load(str(saved[0] / "background"))


def test_a_second_save_needs_overwrite(saved):
    with pytest.raises(Exception, match="exist"):
        M.BackgroundModel.load(str(saved[0] / "background")).save(str(saved[0] / "background"))
