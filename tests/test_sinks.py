from cartlane.plans.catalog import CATALOG
from cartlane.sources.sinks import read_result, write_result
from conftest import SF001


def test_parquet_and_csv_round_trip(spark, tmp_path):
    df = CATALOG["daily_purchase_duration"](spark, SF001)
    expected = sorted(map(tuple, df.collect()), key=repr)
    for fmt in ("parquet", "csv"):
        path = write_result(df, str(tmp_path / fmt), fmt=fmt, single_file=(fmt == "csv"))
        back = read_result(spark, path, df.schema, fmt=fmt)
        assert sorted(map(tuple, back.collect()), key=repr) == expected
