"""Around an agent: outbound rows, requests and replies, transcripts, routes, boxes on screen, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import js
from cloakwork.functions.dialect import Spark
from cloakwork.operators import act, elements, redact

# Sizes, names and patterns that results depend on.
SENT, PREVIEW = 1600, 180
ACTIONS = ("click", "type", "scroll", "navigate", "autofill", "select", "press_key", "hover", "wait", "finish")
CONFIDENCE = 0.95
REPLY = "thought string, action string, targetIndex int, selector string, targetText string, value string, url string, keyName string, direction string, amount int, confidence double"
REQUEST = "goal string, title string, url string, sanitizedText string, safeElements array<struct<index:int,tag:string,text:string,ariaLabel:string,placeholder:string,type:string,id:string,name:string,selector:string>>, redactedScreenshot string"
WAKE = r"\b(?:hey|ok|hi|hello)?\s*nova\b"
WAKE_COMMAND = r"\b(?:hey|ok|hi|hello)?\s*nova(?:\s*[,:]\s*|\s+)(.*)$"
FRAGMENT = r"\s+(?:op|an|th|wh)\s*$"
POLICY = r"\b(?:policy|privacy|terms|cancellation|refund|contact|support|kyc)\b"
POLICY_NAME = r"\b(?:find|locate|search for)?\s*([a-z\s]+(?:policy|terms|cancellation|refund|support|kyc))\b"
WIDEST, TALLEST, TALLEST_FACE = 480, 60, 280
FACES = ("AVATAR", "FACE")


def secret(e: Column, entities: Column) -> Column:
    """Must nothing of an element leave: it is sensitive, a field of personal data by its names, an area's code, or
    an entity's own field. A field is an entity's if one's value holds the other's, from three characters on."""
    low, own = F.lower(js.trim(e["value"])), lambda x: F.lower(x["value"])
    held = F.exists(entities, lambda x: (x["category"] != "NAME") & (F.length(x["value"]) >= 3) & (F.contains(low, own(x)) | F.contains(own(x), low)))
    linked = e["tag"].isin("input", "textarea") & (F.length(low) >= 3) & held
    return e["is_sensitive"] | e["field"].isNotNull() | linked | ((e["tag"] == "input") & e["in_code"] & e["value"].rlike("^[0-9]{1,8}$"))


#: An element's category by its own names and value (operators/act.py), for an element e.
FIELD = act.element_category(Spark(), "lower(concat(e.name, ' ', e.id, ' ', e.placeholder, ' ', e.aria, ' ', e.role))", "e.tag", "e.type", "e.name", "e.role", "e.value", "concat(e.name, ' ', e.id, ' ', e.placeholder, ' ', e.aria)")


def payloads(pages: DataFrame, *keys: str) -> DataFrame:
    """What may leave for each page (keys, html): the redacted text, at most SENT characters of it, the
    sanitized elements as JSON, counters, masks, and the preview that an audit shows. Nothing raw
    is kept. A page is parsed once and never leaves its row. The gate reads all that would leave, elements too, and
    also blocks a page whose password stands anywhere in it."""
    rows = elements.with_tree(pages, *keys)
    rows = rows.select(*keys, elements.page_text(F.col("page")).alias("text"), elements.element_array(F.col("page")).alias("found"))
    rows = rows.withColumn("found", F.expr(f"transform(found, e -> named_struct('e', e, 'field', {FIELD}))"))
    rows = rows.withColumn("found", F.transform("found", lambda x: x["e"].withField("field", x["field"])))
    rows = redact.protect(rows)
    ordered, entities = redact.maskable(F.col("entities")), F.col("entities")
    # An element is its own entity here: what is secret has been decided on all entities.
    marked = F.transform("found", lambda e: F.struct(e.alias("e"), F.struct(e["idx"].alias("index"), e["tag"].alias("tag"), e["text"].alias("text"), e["aria"].alias("aria_label"), e["placeholder"].alias("placeholder"), e["value"].alias("value"), secret(e, entities).alias("is_sensitive")).alias("x")))
    nobody = F.array().cast("array<struct<category:string,element:int>>")

    def sent(m: Column) -> Column:
        clean = redact.sanitize_element(m["x"], nobody, ordered)
        return F.struct(*(clean[a].alias(b) for a, b in (("index", "index"), ("tag", "tag"), ("text", "text"), ("aria_label", "ariaLabel"), ("placeholder", "placeholder"))), *(m["e"][n].alias(n) for n in ("type", "id", "name", "selector")))

    rows = rows.withColumn("elements", F.transform(marked, sent))
    said = F.array_join(F.transform("elements", lambda e: F.concat_ws("\n", *(e[n] for n in ("text", "ariaLabel", "placeholder", "type", "id", "name", "selector")))), "\n")
    rows = rows.withColumn("leaving", F.concat_ws("\n", "redacted", said))
    password = F.exists("found", lambda e: (e["type"] == "password") & (F.length(e["value"]) >= 4) & F.contains(F.col("leaving"), e["value"]))
    safe = redact.gate(F.col("leaving"), entities)["is_safe"] & ~F.coalesce(password, F.lit(True))
    masks = F.array_join(F.transform("entities", lambda e: e["mask"]), ",")
    return rows.select(*keys, F.substring("redacted", 1, SENT).alias("sanitized_text"), F.to_json("elements").alias("elements"), F.concat(F.substring("redacted", 1, PREVIEW), F.lit("...")).alias("preview"), masks.alias("masks"), F.length("redacted").alias("bytes_sent"), F.size("entities").alias("detected"), "high_risk", "exposure", F.when(safe, 0).otherwise(1).alias("blocked"))


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return js.trim(F.regexp_replace(js.trim(reply), "^(?:```json)?(?:```)?|```$", ""))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parsed_reply(reply: Column) -> Column:
    """The action of a reply; null where it is no JSON, lacks the thought or names no known action."""
    valid = lambda got: got["thought"].isNotNull() & got["action"].isin(*ACTIONS) & (got["direction"].isNull() | got["direction"].isin("up", "down", "top", "bottom"))
    return _once(F.from_json(unfenced(reply), REPLY), lambda got: F.when(valid(got), got.withField("confidence", F.coalesce(got["confidence"], F.lit(CONFIDENCE)))))


def parsed_request(body: Column) -> Column:
    """A plan request; null where a required field is missing."""

    def checked(got: Column) -> Column:
        valid = F.forall(F.coalesce(got["safeElements"], F.array()), lambda e: e["index"].isNotNull() & e["tag"].isNotNull() & e["text"].isNotNull())
        for name in ("goal", "title", "url", "sanitizedText", "safeElements"):
            valid = got[name].isNotNull() & valid
        return F.when(valid, got)

    return _once(F.from_json(body, REQUEST), checked)


def transcripts(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, transcript, spoken, woken, command) of recognition results (keys, pos, is_final, text): final
    parts, then the interim ones."""
    text = lambda final: F.array_join(F.transform(F.filter("parts", lambda p: p["is_final"] == final), lambda p: p["text"]), "")
    rows = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "is_final", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    rows = rows.withColumn("transcript", js.trim(F.concat(text(True), F.lit(" "), text(False))))
    woken = js.matches(F.col("transcript"), WAKE, True)
    return rows.select(*keys, "transcript", js.trim(js.replace(F.col("transcript"), FRAGMENT, "", True)).alias("spoken"), woken.alias("woken"), F.when(woken, js.trim(js.extract(F.col("transcript"), WAKE_COMMAND, 1, True))).otherwise(F.lit("")).alias("command"))


def held_box(category: Column, box: Column) -> Column:
    """A finding's box: no larger than a text's, or a face's, and rounded half up."""
    tall = F.when(category.isin(*FACES), F.least(box["height"], F.lit(TALLEST_FACE))).otherwise(F.least(box["height"], F.lit(TALLEST)))
    sizes = {"x": box["x"], "y": box["y"], "width": F.least(box["width"], F.lit(WIDEST)), "height": tall}
    return F.struct(*(js.half_up(v).cast("int").alias(n) for n, v in sizes.items()))


def on_screen(box: Column, width: Column, height: Column) -> Column:
    """Is some of the box within the viewport."""
    return (box["width"] > 0) & (box["height"] > 0) & (box["y"] + box["height"] > 0) & (box["y"] < height) & (box["x"] + box["width"] > 0) & (box["x"] < width)


def avatar(box: Column) -> Column:
    """Has a picture an avatar's size."""
    return box["width"].between(24, 320) & box["height"].between(24, 320)


def seal(category: Column, contextual: Column, width: Column, height: Column, scale: Column) -> Column:
    """struct<label, font>: what is painted over a box, by its width and height."""
    badge = F.when(contextual, " [ML]").otherwise("")
    shield = lambda word: F.concat(F.lit(f"🔒 [{word}"), category, badge, F.lit("]"))
    label = F.when(category.isin(*FACES), "🔒 [BLURRED: FACE / AVATAR]").when(width < 60, F.concat(F.lit("🔒 "), F.substring(category, 1, 3))).when(width < 110, shield("")).when(width < 160, shield("MASKED: ")).otherwise(shield("SHIELDED: "))
    font = F.when(category.isin(*FACES), F.greatest(F.lit(9), F.least(F.lit(11), js.half_up(scale * 10)))).otherwise(F.greatest(F.lit(9), F.least(F.lit(12), js.half_up(F.least(height * 0.55, scale * 11)))))
    return F.struct(label.alias("label"), font.cast("int").alias("font"))


def mission_log(steps: DataFrame, *keys: str) -> DataFrame:
    """(keys, log): each mission's steps (pos, action, status) and counts as one JSON text."""
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("stepIndex"), "action", "status"))).alias("steps"), F.count_if(F.col("status") == "completed").alias("done"), F.count("*").alias("n"))
    status = F.when(F.col("done") == F.col("n"), "completed").otherwise("partial")
    return rows.select(*keys, F.to_json(F.struct(status.alias("status"), F.col("n").alias("totalSteps"), F.col("done").alias("completedSteps"), "steps")).alias("log"))


def write_json(rows: DataFrame, path: str) -> None:
    """Replaces what is there by a JSON line for each row: metrics, logs, the vault and macros."""
    rows.write.mode("overwrite").json(path)


def read_vault(spark, path: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, value) of a stored vault: fields that are no strings count as empty ones."""
    rows = spark.read.schema(", ".join(f"`{f}` string" for f in fields)).json(path)
    return rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f"`{f}`", F.lit("")).alias("value")) for f in fields))).alias("x")).select("x.*")
