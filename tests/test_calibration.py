import numpy as np

from quarry.operators import calibration


def test_beta_fit_finds_the_parameters():
    rng = np.random.default_rng(3)
    for a, b in ((5, 2), (0.7, 0.9), (40, 3), (2, 30)):
        x = np.clip(rng.beta(a, b, 200_000), 1e-4, 1 - 1e-4)
        got = calibration.fit_beta(np.log(x).mean(), np.log1p(-x).mean())
        assert np.allclose(got, (a, b), rtol=0.03)


def test_floor_lies_between_the_populations(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(8):
        centre = rng.normal(size=16) + 2
        rows += [(g, 100 * g + i, (centre + rng.normal(size=16) * 0.3).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    found = calibration.calibrate(df, "g", "i", "v", 16)
    assert (found.n_galleries, found.n_genuine, found.n_impostor) == (8, 240, 240 * 7)
    assert 0.8 < found.certain_similarity < 1 and found.bootstrap_sd < 0.05
    assert calibration.calibrate(df.where("g < 3"), "g", "i", "v", 16) is None
