"""Queries over entities with places on the screen, and over elements to be sanitized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import redact, resolve

_FINDING = "struct<category:string,value:string,risk:string,source:string,confidence:double,box:struct<top:int,left:int,width:int,height:int>,element:int,selector:string>"


def _f(category, value, box=None, element=None, confidence=0.99, risk="MEDIUM"):
    return (category, value, risk, "RULEBOOK", confidence, box, element, f"#e{element}" if element is not None else None)


#: Pages of boxed findings: the same place, far apart, contained, and overlapping ones.
PAGES = (
    (1, [_f("PHONE", "9876543210", (10, 10, 100, 20)), _f("PHONE", "+91 9876543210", (12, 11, 120, 20), 3, 0.5)]),
    (2, [_f("PHONE", "9876543210", (10, 10, 100, 20)), _f("PHONE", "9876543210", (90, 10, 100, 20)), _f("PHONE", "9876543210", (90, 10, 140, 20))]),
    (3, [_f("ADDRESS", "ghaziabad 201206", (10, 10, 100, 20)), _f("ADDRESS", "12 Hill Road near ghaziabad 201206 east side")]),
    (4, [_f("ADDRESS", "ghaziabad 201206", (10, 10, 100, 20)), _f("ADDRESS", "12 Hill Road near ghaziabad 201206 east side", (300, 10, 100, 20))]),
    (5, [_f("EMAIL", "a@b.example", (10, 10, 100, 20), risk="LOW"), _f("EMAIL", "c@d.example.org", (12, 20, 100, 20), risk="LOW")]),
    (6, [_f("EMAIL", "a@b.example", (10, 10, 100, 20)), _f("EMAIL", "c@d.example", (12, 20, 100, 20))]),
    (7, [_f("AVATAR", "image", (0, 0, 64, 64)), _f("CARD", "4532 8921 4455 8821", (200, 0, 900, 200), risk="HIGH"), _f("CVV", "392", (201, 600, 30, 20), risk="HIGH")]),
    (8, []),
)
ELEMENTS = (
    (0, "button", "Mail a@b.example now", "To A@B.example", None, None, False),
    (1, "input", "secret", None, "type here", "hunter2", True),
    (2, "a", "Home", "", "", None, False),
    (3, "input", "9876543210", "Phone", "Phone", "9876543210", False),
)


def _entities(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PAGES, f"page_id int, findings array<{_FINDING}>")
    return resolve.with_entities(rows, boxed=True)


def boxed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark).select("page_id", F.posexplode_outer("entities").alias("pos", "e")).where("pos is not null")
    return rows.select("page_id", "pos", "e.id", "e.category", "e.value", "e.mask", "e.confidence", "e.element", *(F.col(f"e.box.{k}").alias(k) for k in ("top", "left", "width", "height")))


def painted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on an image of 1600 by 1200 px of a view 800 px wide, scaled and merged."""
    image = F.struct(F.lit(1600).alias("width"), F.lit(1200).alias("height"))
    scale = F.lit(2.0)
    rows = _entities(spark).withColumn("boxes", F.transform(F.filter("entities", lambda e: e["box"].isNotNull()), lambda e: redact.scaled_box(e, image, F.lit(800), F.lit(1.0))))
    rows = rows.withColumn("boxes", redact.merge_boxes(F.col("boxes"), scale, F.least(scale * 520, F.lit(960.0)), F.least(scale * 80, F.lit(180.0))))
    return rows.select("page_id", F.posexplode_outer("boxes").alias("pos", "b")).where("pos is not null").select("page_id", "pos", "b.*")


def sanitize_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = "struct<index:int,tag:string,text:string,aria_label:string,placeholder:string,value:string,is_sensitive:boolean>"
    rows = spark.createDataFrame([(1, [_f("EMAIL", "a@b.example"), _f("PHONE", "9876543210", None, 3)], list(ELEMENTS))], f"page_id int, findings array<{_FINDING}>, elements array<{element}>")
    rows = resolve.with_entities(rows, boxed=True)
    rows = rows.withColumn("order", redact.maskable(F.col("entities")))
    return rows.select("page_id", F.explode_outer(F.transform("elements", lambda e: redact.sanitize_element(e, F.col("entities"), F.col("order")))).alias("e")).select("page_id", "e.*")


QUERIES = {"boxed_entities": boxed_entities, "painted_boxes": painted_boxes, "sanitize_elements": sanitize_elements}
_N, _S = "cast(null as int)", "cast(null as string)"
#: The results that the rules give by hand.
SQL = {
    "boxed_entities": f"""select cast(c0 as int) as page_id, cast(c1 as int) as pos, c2 as id, c3 as category, c4 as value, c5 as mask, cast(c6 as double) as confidence, cast(c7 as int) as element, cast(c8 as int) as top, cast(c9 as int) as "left", cast(c10 as int) as width, cast(c11 as int) as height from (values
      (1, 0, 'pii_phone_1', 'PHONE', '+91 9876543210', '[PHONE_1]', 0.99, 3, 10, 10, 100, 20),
      (2, 0, 'pii_phone_1', 'PHONE', '9876543210', '[PHONE_1]', 0.99, null, 10, 10, 100, 20), (2, 1, 'pii_phone_2', 'PHONE', '9876543210', '[PHONE_2]', 0.99, null, 90, 10, 140, 20),
      (3, 0, 'pii_address_1', 'ADDRESS', '12 Hill Road near ghaziabad 201206 east side', '[REDACTED_LOCATION]', 0.99, null, 10, 10, 100, 20),
      (4, 0, 'pii_address_1', 'ADDRESS', 'ghaziabad 201206', '[REDACTED_LOCATION]', 0.99, null, 10, 10, 100, 20), (4, 1, 'pii_address_2', 'ADDRESS', '12 Hill Road near ghaziabad 201206 east side', '[REDACTED_LOCATION]', 0.99, null, 300, 10, 100, 20),
      (5, 0, 'pii_email_1', 'EMAIL', 'c@d.example.org', '[EMAIL_1]', 0.99, null, 12, 20, 100, 20),
      (7, 0, 'pii_avatar_1', 'AVATAR', 'image', '[BLURRED_AVATAR]', 0.99, null, 0, 0, 64, 64), (7, 1, 'pii_card_1', 'CARD', '4532 8921 4455 8821', '[CARD_1]', 0.99, null, 200, 0, 900, 200), (7, 2, 'pii_cvv_1', 'CVV', '392', '███', 0.99, null, 201, 600, 30, 20)
    ) t(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11)""",
    "sanitize_elements": f"""select * from (values (1, 0, 'button', 'Mail [EMAIL_1] now', 'To [EMAIL_1]', {_S}, {_S}, false), (1, 1, 'input', '[SENSITIVE_FIELD]', {_S}, '[REDACTED_INPUT]', {_S}, true),
      (1, 2, 'a', 'Home', {_S}, {_S}, {_S}, false), (1, 3, 'input', '[SENSITIVE_FIELD]', 'Phone', '[REDACTED_INPUT]', {_S}, true)) t(page_id, "index", tag, text, aria_label, placeholder, value, is_sensitive)""",
}
