import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from raremill.llm import decontaminate, secrets, tasks, toxicity


def model_of(name):
    if name == "index":
        index = decontaminate.Index([(1, [f"w{k}" for k in range(30)])], 0.2, 0.99, 7)
        return lambda: list(index.find([[f"w{k}" for k in range(30)]]))
    if name == "model":
        weights = np.array([[1.0, 0.0], [0.6, 0.8]])
        model = toxicity.Model(["aa", "bb"], np.ones(2), np.array([1, 2]), np.array([1.0, 0.0]), weights, 1, 0.1)
        return lambda: model.score(toxicity.Vectors(model.terms).counts("aa aa bb"))[0]
    draw = np.random.default_rng(0)
    pieces = ["".join(draw.choice(list("abc123"), secrets._SIZE)) for _ in range(40)]
    network = secrets.fit(pieces, np.arange(40) % 2, 0.99, 3)
    return lambda: network.scores(secrets._codes(pieces))


@pytest.mark.parametrize("name", ["index", "model", "network"])
def test_models_travel_with_their_code(name, tmp_path):
    """Executors need not have the package installed."""
    path = tmp_path / "task"
    path.write_bytes(cloudpickle.dumps(model_of(name)))
    code = f"import pickle; print(pickle.load(open({str(path)!r}, 'rb'))() is not None)"
    done = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, cwd="/")
    assert done.stdout.strip() == "True", done.stderr[-500:]


def test_lists_that_do_not_fit_raise():
    assert tasks.int_lists(np.arange(3), [1, 0, 2]).to_pylist() == [[0], [], [1, 2]]
    with pytest.raises(OverflowError):
        tasks.int_lists(np.empty(0), [1 << 30, 1 << 30])
