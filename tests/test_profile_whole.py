import math
import random
import re

import pytest

from glimmerframe.plans import load_all, registry

load_all()
NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def test_p3_profile_has_malformed_text_and_change_of_every_column(spark, tmp_path):
    r = random.Random(5)
    frames = [(f"rec{i % 3}", load, r.gauss(0, 1) + (9 if load == 2 else 0) if i % 10 else r.choice([None, float("nan"), float("inf")])) for load in (1, 2, 3, None) for i in range(3000)]
    frames += [("???", 3, 0.0)] * 30
    texts = [(load, f"{i}", f"{i}.5" if load != 2 or i % 2 else f"{i},5") for load in (1, 2, 3) for i in range(400)] + [(3, None, "x")]
    spark.createDataFrame(frames, "recording_id string, load_id long, Cell_1 double").selectExpr("*", "timestamp_seconds(load_id * 100) AS loaded_at").write.parquet(f"{tmp_path}/raw_df.parquet")
    spark.createDataFrame(texts, "load_id long, Time string, Cell_1 string").write.parquet(f"{tmp_path}/raw_records.parquet")
    rows = registry.QUERIES["p3_profile"](spark, str(tmp_path)).collect()
    p = {(x.table_name, x.column_name, x.load_id): x for x in rows}
    assert len(rows) == len(p) == 4 * 4 + 3 * 3
    for load in (1, 2, 3, None):
        x, values = p["raw_df", "Cell_1", load], [v for _, k, v in frames if k == load]
        full = [v for v in values if v is not None]
        bad = sum(not math.isfinite(v) for v in full)
        assert x.distinct_values == len({str(v) for v in full})
        assert x.malformed_rate == pytest.approx(bad / len(full), abs=1e-6) and x.nonconforming_rate is None
        rest = [v for _, k, v in frames if k != load]
        assert x.null_rate_change == pytest.approx(values.count(None) / len(values) - rest.count(None) / len(rest), abs=1e-6)
    assert p["raw_df", "Cell_1", 2].change > 0.9 and p["raw_df", "Cell_1", 1].change < 0.4
    assert p["raw_df", "loaded_at", 2].change == 1 and p["raw_df", "loaded_at", None].change is None
    assert p["raw_df", "recording_id", 3].malformed_rate == p["raw_df", "recording_id", 3].nonconforming_rate == pytest.approx(30 / 3030, abs=1e-6)
    assert p["raw_df", "recording_id", 1].malformed_rate == 0
    for load in (1, 2, 3):
        own = [v for k, _, v in texts if k == load]
        assert p["raw_records", "Cell_1", load].malformed_rate == pytest.approx(sum(not NUMBER.fullmatch(v) for v in own) / len(own), abs=1e-6)
        assert p["raw_records", "Cell_1", load].distinct_values == len(set(own))
    assert p["raw_records", "Cell_1", 2].change == pytest.approx(0.5, abs=1e-6) and p["raw_records", "Time", 1].change == 0
    named = {(x.table_name, x.column_name) for x in registry.QUERIES["p3_expressions"](spark, str(tmp_path)).collect()}
    assert named == {("raw_df", "recording_id"), ("raw_records", "Time"), ("raw_records", "Cell_1")}
