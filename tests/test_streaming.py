from tablehaul.operators import validate
from tablehaul.plans import legacy
from tablehaul.streaming import flow

SMALL = "/root/testdata/sf0.001"


def test_stream_routes_like_the_batch(spark, tmp_path):
    raw = legacy.legacy_orders(spark, SMALL)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    checked = flow.validated_stream(stream, legacy.TARGETS, legacy.MAPPING, validate.row_checks(legacy.RULES), "order_no")
    run = flow.start_routing(checked, "order_no", str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert run.awaitTermination(120) and run.exception() is None
    want = validate.in_out_counts(legacy.checked_orders(spark, SMALL)).first()
    ok, bad = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "bad"))
    assert (ok.count(), bad.count()) == (want.rows_out, want.rows_rejected)
    assert ok.select("batch").distinct().count() >= 2
