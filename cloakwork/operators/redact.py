"""Redaction, the leak gate, sanitized elements, outbound rows and box geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import checks, js
from cloakwork.operators import detect, resolve
from cloakwork.operators.rules import LIVE_SECRET

# Headings that are never masked.
EXEMPT = r"\b(?:two-factor|2fa|authentication|active otp)\b"
EXEMPT_ADDRESS = r"\b(?:otp|auth|factor|2fa|verification)\b"
STRICT, BALANCED, PERMISSIVE = "STRICT", "BALANCED", "PERMISSIVE"
SECRET_REASON = "CRITICAL: Live unmasked API Key or Secret detected in sanitized payload. Transmission blocked."
LEFT_REASON = "FAIL-CLOSED: Residual unmasked PII string detected in sanitized payload."


def maskable(entities: Column) -> Column:
    """Entities to mask, by length of the value, longest first, ties in their order."""
    low = lambda e: F.lower(js.trim(e["value"]))
    exempt = lambda e: (e["category"] == "NAME") | checks.brand(e["value"]) | js.matches(low(e), EXEMPT, True) | ((e["category"] == "ADDRESS") & js.matches(low(e), EXEMPT_ADDRESS, True))
    kept = F.filter(entities, lambda e: ~exempt(e) & (F.length(e["value"]) >= 2))
    keyed = F.transform(kept, lambda e, i: F.struct((-F.length(e["value"])).alias("n"), i.alias("i"), e["value"].alias("value"), e["mask"].alias("mask")))
    return F.sort_array(keyed)


def redact(text: Column, ordered: Column) -> Column:
    """Replaces every value, in any case, one entity after the other. A pattern made at run time is compiled for each row and value, so
    values without letters, which have one case, are replaced as they are."""
    pattern = lambda e: F.concat(F.lit("(?i)"), js.literal(e["value"]))
    step = lambda t, e: F.when(e["value"].rlike("[A-Za-z]"), F.regexp_replace(t, pattern(e), js.literal(e["mask"]))).otherwise(F.replace(t, e["value"], e["mask"]))
    return F.aggregate(ordered, text, step)


def gate(text: Column, entities: Column, mode: str | Column = BALANCED) -> Column:
    """struct<is_safe, action, reason>; a null anywhere blocks."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    high = resolve.risk_count(entities, "HIGH")
    blocked = lambda action, reason: F.struct(F.lit(False).alias("is_safe"), F.lit(action).alias("action"), reason.alias("reason"))
    strict = F.concat(F.lit("STRICT MODE: "), high.cast("string"), F.lit(" high-risk sensitive entities (Pass/Card/Aadhaar) present on page."))
    left = F.exists(entities, lambda e: F.contains(text, e["value"]))
    safe = F.struct(F.lit(True).alias("is_safe"), F.lit("PROCEED").alias("action"), F.lit(None).cast("string").alias("reason"))
    return (
        F.when(text.isNull() | entities.isNull() | mode.isNull(), blocked("BLOCK", F.lit(LEFT_REASON)))
        .when(js.matches(text, LIVE_SECRET), blocked("BLOCK", F.lit(SECRET_REASON)))
        .when((mode == STRICT) & (high > 0), blocked("REQUIRE_USER_REVIEW", strict))
        .when(F.coalesce(left, F.lit(True)), blocked("BLOCK", F.lit(LEFT_REASON)))
        .otherwise(safe)
    )


def protect(rows: DataFrame, text: str = "text", mode: str = BALANCED) -> DataFrame:
    """Adds findings, entities, the redacted text, scores and the gate to every row. All
    of it is one stage over the scan: no shuffle, and no text in a second place."""
    rows = resolve.with_entities(detect.with_findings(rows, text))
    rows = rows.withColumn("__order", maskable(F.col("entities")))
    rows = rows.withColumn("redacted", redact(F.coalesce(F.col(text), F.lit("")), F.col("__order"))).drop("__order")
    counts = {f"{risk.lower()}_risk": resolve.risk_count(F.col("entities"), risk) for risk in ("HIGH", "MEDIUM", "LOW")}
    rows = rows.withColumns({"gate": gate(F.col("redacted"), F.col("entities"), mode), **counts})
    return rows.withColumn("exposure", resolve.exposure(F.col("high_risk"), F.col("medium_risk"), F.col("low_risk")))


def sanitize_element(e: Column, entities: Column, ordered: Column) -> Column:
    """An element without its secrets: a sensitive one shows placeholders, another has its
    texts redacted."""
    secret = F.coalesce(e["is_sensitive"], F.lit(False)) | F.exists(entities, lambda x: x["element"].eqNullSafe(e["index"]) & (x["category"] != "NAME"))
    clean = lambda c: F.when(F.coalesce(c, F.lit("")) != "", redact(c, ordered))
    return F.struct(
        e["index"].alias("index"),
        e["tag"].alias("tag"),
        F.when(secret, F.lit("[SENSITIVE_FIELD]")).otherwise(redact(F.coalesce(e["text"], F.lit("")), ordered)).alias("text"),
        F.when(secret, e["aria_label"]).otherwise(clean(e["aria_label"])).alias("aria_label"),
        F.when(secret, F.when(F.coalesce(e["placeholder"], F.lit("")) != "", F.lit("[REDACTED_INPUT]"))).otherwise(clean(e["placeholder"])).alias("placeholder"),
        F.when(~secret, e["value"]).alias("value"),
        secret.alias("is_sensitive"),
    )


def scaled_box(e: Column, image: Column, view_width: Column, ratio: Column) -> Column:
    """An entity's box on the image: scaled, padded by 2 px and held to the largest size."""
    scale = F.when((view_width > 0) & (image["width"] > 0), image["width"] / view_width).when(ratio > 0, ratio).otherwise(F.lit(1.0))
    face = e["category"].isin("AVATAR", "FACE")
    widest = F.least(scale * 520, image["width"] * 0.60)
    tallest = F.when(face, F.least(scale * 320, image["height"] * 0.40)).otherwise(F.least(scale * 80, image["height"] * 0.15))
    b = e["box"]
    return F.struct(
        (b["left"] * scale - 2).alias("x"),
        (b["top"] * scale - 2).alias("y"),
        F.least(b["width"] * scale + 4, widest).alias("w"),
        F.least(b["height"] * scale + 4, tallest).alias("h"),
        face.alias("face"),
        (e["risk"] == "HIGH").alias("high"),
    )


# What an image model's channels are centred and scaled by.
CHANNEL_MEANS, CHANNEL_SCALES = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def channels(pixels: Column) -> Column:
    """An image's bytes (red, green, blue and opacity of one pixel after the other) as normalized values, one
    whole channel after the other."""
    count = (F.size(pixels) / 4).cast("int")
    at = lambda c: F.transform(F.sequence(F.lit(0), count - 1), lambda i: (F.get(pixels, i * 4 + c) / 255.0 - CHANNEL_MEANS[c]) / CHANNEL_SCALES[c])
    return F.when(count > 0, F.concat(at(0), at(1), at(2))).otherwise(F.array().cast("array<double>"))


AREA = "struct<x:double,y:double,w:double,h:double,face:boolean,high:boolean>"


def merge_boxes(boxes: Column, scale: Column, widest: Column, tallest: Column) -> Column:
    """Greedy union, in order: a box joins the first box of its row that it touches within
    5 px, if the union stays within the largest size; faces stay alone."""

    def put(acc: Column, b: Column) -> Column:
        joined = lambda t: F.struct(
            F.least(b["x"], t["x"]).alias("x"),
            F.least(b["y"], t["y"]).alias("y"),
            (F.greatest(b["x"] + b["w"], t["x"] + t["w"]) - F.least(b["x"], t["x"])).alias("w"),
            (F.greatest(b["y"] + b["h"], t["y"] + t["h"]) - F.least(b["y"], t["y"])).alias("h"),
            t["face"].alias("face"),
            (t["high"] | b["high"]).alias("high"),
        )
        near = lambda t, at, size: (b[at] < t[at] + t[size] + 5) & (b[at] + b[size] + 5 > t[at])
        fits = lambda t: ~t["face"] & ~b["face"] & (F.abs(b["y"] - t["y"]) <= scale * 20) & near(t, "x", "w") & near(t, "y", "h") & (joined(t)["w"] <= widest) & (joined(t)["h"] <= tallest)
        first = F.array_position(F.transform(acc, fits), F.lit(True)).cast("int")
        return F.when(first == 0, F.array_append(acc, b)).otherwise(F.transform(acc, lambda t, i: F.when(i + 1 == first, joined(t)).otherwise(t)))

    return F.aggregate(boxes.cast(f"array<{AREA}>"), F.array().cast(f"array<{AREA}>"), put)
