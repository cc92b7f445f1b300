"""Texts, documents and maps are read once for each row, not once for each value taken from them."""

from pyspark.sql import functions as F

from seriesloom.functions import variants as V
from seriesloom.operators import metadata


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layered_documents_are_parsed_once(spark):
    texts = spark.createDataFrame([(1, '[{"vdr_dm_data": {"level1": {"max_pq": 0}}}, 5, {}]'), (2, '{"frames": []}'), (3, "{bad"), (4, None)], "id int, t string")
    df = V.frame_levels(texts.select("id", F.try_parse_json("t").alias("doc")), "doc", ["id"])
    assert optimized(df).lower().count("parse_json(") <= 1 and "Filter (size(" not in optimized(df) and "schemaofvariant(doc" not in optimized(df).replace("_", "").lower()
    assert sorted((r.id, r.frame, r.l1_max_nits) for r in df.collect()) == [(1, 0, 0.0), (1, 1, None)]


def test_probes_are_parsed_once(spark):
    probes = spark.createDataFrame([(1, '{"streams": [{"index": 0, "bit_rate": "N/A"}, {"index": " 2 ", "bit_rate": "+7"}, {"index": -1}, {"index": "x1"}, null]}'), (2, "{bad"), (3, '{"streams": []}'), (4, None)], "id int, t string")
    df = metadata.audio_streams(probes, "id", "t")
    assert optimized(df).count("from_json(") == 1
    assert sorted((r["id"], r["index"], r["bitrate"]) for r in df.collect()) == [(1, 0, 0), (1, 2, 7)]


def test_dynamic_properties_are_read_once(spark):
    rows = spark.createDataFrame([({"dovi_target_nits": "x", "Dovi_Target_Nits ": "1e3", "rpu_L6_MaxCLL": "NaN", "dolby_l5_left": "-1", "DolbyVision_L5_Left": " 4 ", "dovi_l1_max": "inf"},)], "props map<string,string>")
    df = rows.select(metadata.dynamic_metadata(F.col("props")).alias("m")).select("m.*")
    assert optimized(df).count("map_entries(") == 1
    r = df.first()
    assert (r.target_nits, r.l5_left, r.l1_maximum, r.rpu_present) == (1000.0, 4, float("inf"), None) and r.l6_max_cll != r.l6_max_cll
