"""The grid of exponents takes one power a step; squares are products."""

from stayline.operators import model
from stayline.session import configure


def test_one_power_a_step_and_the_least_error(spark):
    rows = [("a", 0, 0.2, 0.9), ("a", 1, 0.3, 0.7), ("b", 0, 0.1, 0.95), ("b", 1, 0.5, 0.6)]
    out = model.calibrate_k(configure(spark).createDataFrame(rows, "video_id string, idx int, p double, actual_r double"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("power(") == 1
    raw = {}
    for video, idx, p, _ in rows:
        raw[video, idx] = raw.get((video, idx - 1), 1.0) * (1 - p)
    grid = [0.1 + i * 0.01 for i in range(191)]
    error = {k: sum((raw[v, i] ** k - a) ** 2 for v, i, _, a in rows) / len(rows) for k in grid}
    got = out.first()
    assert abs(got["k"] - min(grid, key=error.get)) < 1e-9 and abs(got["mse"] - min(error.values())) < 1e-12
