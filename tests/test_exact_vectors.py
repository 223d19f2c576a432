"""Vectors in a band against all pairs, none missed."""

import numpy as np

from marlstone.operators import pairs


def test_no_vector_of_the_band_is_missed(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[300:340] = x[17]
    x[5] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>").repartition(3)
    d = x.astype(np.float64)
    unit = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
    sims = unit @ unit.T
    band = {(q, i) for q in range(0, 700, 50) for i in range(700) if q != i and 0.1 <= round(sims[q, i], 8) < 0.9}
    got = {(r.query_id, r.id): r.sim for r in pairs.similar_vectors(df.where("id % 50 = 0"), df, 0.1, 0.9, tile=90).collect()}
    assert set(got) == band and all(abs(s - sims[k]) < 1e-7 for k, s in got.items())
    best = {(q, i) for q in range(0, 700, 50) for _, i in sorted((-round(sims[q, i], 8), i) for p, i in band if p == q)[:3]}
    assert {(r.query_id, r.id) for r in pairs.similar_vectors(df.where("id % 50 = 0"), df, 0.1, 0.9, top=3, tile=90).collect()} == best
