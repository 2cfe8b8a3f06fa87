"""Type-strict reading of JSON text through VARIANT: a wrong type is a missing value.

Duplicate keys keep their last value where the session allows them
(``spark.sql.variant.allowDuplicateKeys``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import confidence_band, three_decimals, valid_box
from .text import trim_spaces

_LINE_BOX = "struct<x:double,y:double,width:double,height:double>"


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY, ... of a variant; null for none."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_at(v: Column, path: str) -> Column:
    """A string that isn't empty, else null."""
    inner = at(v, path)
    return F.when(kind(inner) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def array_at(v: Column, path: str) -> Column:
    """Elements as variants; empty for anything but an array."""
    inner = at(v, path)
    return F.coalesce(F.when(kind(inner) == "ARRAY", F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(kind(at(v, path)) == "OBJECT", F.lit(False))


def number(v: Column) -> Column:
    return F.when(kind(v).isin("BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT"), F.try_variant_get(v, "$", "double"))


# The mark of the appended script and of its JSON.
SCRIPT_ATTRIBUTE, SCRIPT_SOURCE = "data-scraper-bvshop-item-query", "bvshop:item-query"


def item_query_artifact(query_url: Column, payload: Column) -> Column:
    """JSON of what describes an item, or null if nothing in its data does; the name alone doesn't."""
    v = parsed(payload)
    prod, style = "$.response.prod", "$.response.style"
    photos, answers = array_at(v, f"{prod}.photos"), array_at(v, f"{prod}.q_and_a")
    description = string_at(v, f"{prod}.description")
    styled = F.when(is_object(v, style), string_at(v, f"{style}.style"))
    useful = description.isNotNull() | (F.size(photos) > 0) | (F.size(answers) > 0) | styled.isNotNull()
    item = F.struct(at(v, f"{prod}.id").alias("id"), string_at(v, f"{prod}.name").alias("name"), description.alias("description"), photos.alias("photos"), answers.alias("q_and_a"))
    made = F.struct(F.lit(SCRIPT_SOURCE).alias("source"), query_url.alias("queryUrl"), item.alias("prod"), F.when(is_object(v, style), F.struct(styled.alias("style"))).alias("style"))
    return F.when(is_object(v, prod) & useful, F.to_json(made, {"ignoreNullFields": "false"}))


def append_script(html: Column, json: Column, attribute: str = SCRIPT_ATTRIBUTE) -> Column:
    """Markup with a JSON script at its end, in which no text can close the script."""
    safe = F.regexp_replace(json, "(?i)</script", r"<\\/script")
    return F.concat(html, F.lit(f'\n<script type="application/json" {attribute}>'), safe, F.lit("</script>\n"))


def scripts(html: Column, attribute: str = SCRIPT_ATTRIBUTE) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script[^>]*\b{attribute}\b[^>]*>(.*?)</script>"), F.lit(1))


def has_usable_script(html: Column, attribute: str = SCRIPT_ATTRIBUTE) -> Column:
    """Whether some appended script has its source mark and any data of use."""

    def usable(text: Column) -> Column:
        v = parsed(text)
        any_of = string_at(v, "$.prod.description").isNotNull() | (F.size(array_at(v, "$.prod.photos")) > 0) | (F.size(array_at(v, "$.prod.q_and_a")) > 0) | string_at(v, "$.style.style").isNotNull()
        return F.coalesce((string_at(v, "$.source") == SCRIPT_SOURCE) & any_of, F.lit(False))

    return F.coalesce(F.exists(scripts(html, attribute), usable), F.lit(False))


def layout(text: Column) -> Column:
    """Struct (provider, coordinate_system, lines) of a recognised page, null unless it is one with lines of use.

    A line needs text and a confidence from 0 to 1; a bad box leaves its line without one.
    """
    v = parsed(text)

    def line(x: Column) -> Column:
        box = F.try_variant_get(x, "$.boundingBox", "variant")
        numbers = F.struct(*(number(F.try_variant_get(box, f"$.{c}", "variant")).alias(c) for c in ("x", "y", "width", "height")))
        return F.struct(F.when(kind(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string")).alias("text"), number(F.try_variant_get(x, "$.confidence", "variant")).alias("confidence"), F.when(valid_box(numbers), numbers).cast(_LINE_BOX).alias("bounding_box"))

    good = F.filter(F.transform(array_at(v, "$.lines"), line), lambda x: x["text"].isNotNull() & x["confidence"].between(0, 1))
    system = string_at(v, "$.coordinateSystem")
    ok = string_at(v, "$.provider").isNotNull() & system.isin("normalized-lower-left", "normalized-upper-left") & (F.size(good) > 0)
    return F.when(ok, F.struct(string_at(v, "$.provider").alias("provider"), system.alias("coordinate_system"), good.alias("lines")))


def recognised(stdout: Column, checks=()) -> Column:
    """A recogniser's JSON output as struct (raw_markdown, confidence, notes, fallback_reason, average, line_count).

    checks: functions from an array of line texts to an array of warnings.
    """
    v = parsed(stdout)
    ok = F.coalesce(F.try_variant_get(v, "$.ok", "boolean"), F.lit(False))
    all_lines = F.transform(array_at(v, "$.lines"), lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")).alias("text"), F.try_variant_get(x, "$.confidence", "double").alias("confidence")))
    lines = F.filter(all_lines, lambda x: trim_spaces(x["text"]) != "")
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["confidence"])
    average = F.when(F.size(lines) > 0, three_decimals(total / F.size(lines)))
    reason = F.when(~ok, "PROVIDER_ERROR").when(F.size(lines) == 0, "NO_TEXT")
    found = F.flatten(F.array(*(check(F.transform(lines, lambda x: x["text"])) for check in checks))) if checks else F.array().cast("array<string>")
    said = F.concat_ws(": ", string_at(v, "$.error.code"), string_at(v, "$.error.message"))
    return F.struct(
        F.when(reason.isNull(), F.array_join(F.transform(lines, lambda x: trim_spaces(x["text"])), "\n")).otherwise("").alias("raw_markdown"),
        F.when(reason.isNull(), confidence_band(average)).otherwise("LOW").alias("confidence"),
        F.when(~ok, said).when(reason.isNotNull(), "no text lines returned").otherwise(F.nullif(F.array_join(found, "; "), F.lit(""))).alias("notes"),
        reason.alias("fallback_reason"),
        F.when(reason.isNull(), average).alias("average"),
        F.when(reason.isNull(), F.size(lines)).otherwise(0).alias("line_count"),
    )
