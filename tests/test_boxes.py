"""Boxes on an image, scaled and merged, worked out by hand."""

from pyspark.sql import functions as F

from cloakwork.operators import redact

ENTITY = "struct<category:string,risk:string,box:struct<left:double,top:double,width:double,height:double>>"


def scaled(spark, *entities, image=(1600.0, 1200.0), view=800.0, ratio=1.0):
    rows = spark.createDataFrame([(list(entities), image, view, ratio)], f"es array<{ENTITY}>, image struct<width:double,height:double>, view double, ratio double")
    row = rows.select(F.transform("es", lambda e: redact.scaled_box(e, F.col("image"), F.col("view"), F.col("ratio"))).alias("b")).first()
    return [tuple(b) for b in row["b"]]


def test_boxes_are_scaled_padded_and_held(spark):
    text, wide, face = ("EMAIL", "LOW", (10.0, 20.0, 100.0, 15.0)), ("CARD", "HIGH", (0.0, 0.0, 900.0, 300.0)), ("AVATAR", "MEDIUM", (5.0, 5.0, 400.0, 400.0))
    # Twice the view: left * 2 - 2, width * 2 + 4; texts are held to 520 * 2 or 60 % and 80 * 2 or 15 %, faces to 320 * 2 or 40 % in height.
    assert scaled(spark, text, wide, face) == [(18.0, 38.0, 204.0, 34.0, False, False), (-2.0, -2.0, 960.0, 160.0, False, True), (8.0, 8.0, 804.0, 480.0, True, False)]
    assert scaled(spark, text, view=0.0, ratio=3.0)[0][:4] == (28.0, 58.0, 304.0, 49.0) and scaled(spark, text, view=0.0, ratio=0.0)[0][:4] == (8.0, 18.0, 104.0, 19.0)


def merged(spark, boxes, scale=1.0, widest=300.0, tallest=60.0):
    rows = spark.createDataFrame([(boxes,)], f"b array<{redact.AREA}>")
    row = rows.select(redact.merge_boxes(F.col("b"), F.lit(scale), F.lit(widest), F.lit(tallest)).alias("m")).first()
    return [tuple(b) for b in row["m"]]


def test_boxes_of_a_row_are_merged_in_order(spark):
    box = lambda x, y, w=50.0, h=20.0, face=False, high=False: (x, y, w, h, face, high)
    assert merged(spark, [box(0.0, 0.0), box(54.0, 4.0, high=True)]) == [(0.0, 0.0, 104.0, 24.0, False, True)]
    # Five pixels are no touch any more; another row; too wide a union; faces stay alone.
    assert len(merged(spark, [box(0.0, 0.0), box(55.0, 0.0)])) == 2
    assert len(merged(spark, [box(0.0, 0.0, h=30.0), box(0.0, 21.0)])) == 2
    assert len(merged(spark, [box(0.0, 0.0, w=200.0), box(190.0, 0.0, w=150.0)])) == 2
    assert len(merged(spark, [box(0.0, 0.0, face=True), box(10.0, 0.0)])) == 2
    # The first fitting box takes it, and grows: the third fits only the grown one.
    assert merged(spark, [box(0.0, 0.0), box(200.0, 0.0), box(52.0, 0.0), box(104.0, 0.0)]) == [(0.0, 0.0, 154.0, 20.0, False, False), (200.0, 0.0, 50.0, 20.0, False, False)]
    assert merged(spark, []) == []
