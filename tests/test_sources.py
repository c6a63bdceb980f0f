"""Sources: the study's feature spec, CSV scans with an index column, stage sinks."""

import os
import tempfile

from stayframe import presets as P
from stayframe.session import stage_path
from stayframe.sources import tables as IO


def test_clinical_spec_has_27_features(spark):
    spec = IO.load_feature_spec(spark, csv_text=P.FEATURE_SPEC_CSV)
    items = IO.spec_items(spec)
    assert len(items) == 27
    assert items["arterial_pressure_systolic"] == [6, 51, 455, 220050, 220179, 225309]
    assert items["ph_blood"] == [223830] and "urea" not in items and "scr" in items
    # 27 value + 27 delay columns + 7 others = the 61 published features
    assert 2 * len(items) + 7 == 61


def test_csv_scan_drops_index_column(spark):
    d = tempfile.mkdtemp(prefix="stayframe-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as f:
        f.write(",a,b\n0,1,x\n1,2,y\n")
    df = IO.read_csv(spark, path, "_c0 int, a int, b string")
    assert df.columns == ["a", "b"] and df.count() == 2


def test_stage_sink_roundtrip(spark):
    li = IO.read_table(spark, "lineitem", "/root/testdata/sf0.001")
    path = stage_path(spark, "test_sink_roundtrip")
    IO.write_table(li, path, partition_by=["l_returnflag"])
    back = spark.read.parquet(path)
    assert back.count() == li.count() and set(back.columns) == set(li.columns)
