
from glimmerframe.plans import load_all, registry

load_all()


def test_wide_to_long_has_every_frame(spark, tmp_path):
    cells = [f"Cell_{i}" for i in range(1, 6)]
    rows = [(t, *[float(i * t) for i in range(5)]) for t in (1, 100, 101, 101, 55_183)] + [(0, *[1.0] * 5), (None, *[1.0] * 5), (1_000_000_001, *[1.0] * 5), (7, None, float("nan"), float("inf"), 2.0, 3.0)]
    spark.createDataFrame(rows, "Time long, " + ", ".join(f"{c} double" for c in cells)).write.parquet(f"{tmp_path}/raw_df.parquet")
    got = {(r.cell, r.t): (r.n, r.total) for r in registry.QUERIES["wide_to_long"](spark, str(tmp_path)).collect()}
    want = {(c, t): (n, float(i * t * n)) for i, c in enumerate(cells) for t, n in ((1, 1), (100, 1), (101, 2), (55_183, 1))}
    assert got == want | {("Cell_4", 7): (1, 2.0), ("Cell_5", 7): (1, 3.0)}
