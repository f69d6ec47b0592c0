import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tickloom.operators import models, network
from tickloom.operators.network import Network, NetworkModel, NetworkSpec, NetworkTrainer


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_is_that_of_the_loss(dropout):
    rng = np.random.default_rng(1)
    net = Network([4, 6, 5, 3], seed=2)
    net.flat = net.flat + rng.normal(0, 0.1, len(net.flat))
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9)
    masks = [(rng.random((9, n)) > dropout) / (1 - dropout) for n in (6, 5)] if dropout else []

    def loss(flat):
        return -np.log(Network(net.sizes, flat).forward(x, masks)[0][np.arange(9), y]).mean()

    g = net.gradient(x, y, masks)
    for i in rng.choice(len(net.flat), 40, replace=False):
        step = np.zeros(len(net.flat))
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(net.flat + step) - loss(net.flat - step)) / 2e-6, abs=1e-6)


def test_an_epoch_is_adam_by_hand():
    rng = np.random.default_rng(3)
    x, y, spec = rng.normal(size=(10, 2)), rng.integers(0, 2, 10), NetworkSpec((3,), dropout=0.0, rate=0.01, batch=4)
    net, plain = Network([2, 3, 2], seed=1), Network([2, 3, 2], seed=1)
    moments, steps = network._epoch(net, np.zeros((2, len(net.flat))), 0, x, y, spec, np.random.default_rng(5))
    order, m, v = np.random.default_rng(5).permutation(10), 0.0, 0.0
    for t, rows in enumerate((order[:4], order[4:8], order[8:]), 1):
        g = plain.gradient(x[rows], y[rows])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        plain.flat = plain.flat - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    assert steps == 3
    np.testing.assert_allclose(net.flat, plain.flat, rtol=1e-12)


def test_tasks_averaged_learn_what_no_line_can_tell(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(network, "PART_ROWS", 150)
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (450, 2))
    df = spark.createDataFrame([(int(a * b > 0), float(a), float(b)) for a, b in x], "y int, a double, b double").repartition(3)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df)
    trainer = NetworkTrainer(NetworkSpec((16, 8), dropout=0.1, rate=0.02, epochs=25), 2, 2, "y", "f")
    model = trainer.fit(df)
    rows = model.transform(df).select("y", "a", "__p").orderBy("a").collect()
    assert np.mean([r.y == int(np.argmax(r["__p"])) for r in rows]) > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = NetworkModel.load(str(tmp_path / "m")).transform(df).select("a", "__p").orderBy("a").collect()
    # Products of matrices round by the shape of batches.
    np.testing.assert_allclose([r["__p"] for r in again], [r["__p"] for r in rows], atol=1e-12)


def test_parameters_and_bad_input(spark):
    made = models.create_model("neural_network", {"hidden_layers": [8], "dropout_rate": 0.5, "batch_size": 16, "input_dim": 3, "num_classes": 2}, 2, 3)
    assert (made.spec.hidden, made.spec.dropout, made.spec.batch, made.spec.rate) == ((8,), 0.5, 16, 0.001)
    assert models.create_model("neural_network", {}, 2, 3).spec == NetworkSpec()
    with pytest.raises(ValueError, match="activation"):
        models.create_model("neural_network", {"activation": "cube"}, 2, 3)
    with pytest.raises(ValueError, match="dropout"):
        NetworkSpec(dropout=1.0)
    empty = spark.createDataFrame([], "y int, x array<double>").withColumn("y", F.col("y"))
    assert len(network.fit_network(empty, 2, 3, NetworkSpec(epochs=2), "y", "x").flat) == len(Network([3, 64, 32, 2]).flat)
