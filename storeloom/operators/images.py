"""Selection of a page's images: which are worth reading, and why the others aren't.

Input: rows (page_id, pos, url), pos the order on the page. Output: the same rows with kept,
reason, note and drop_order (the order of the drops; null for kept rows). Every
step is a window over a page and URL or image, so a page is never gathered in one
row, and shuffles are those of the windows' keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions import urls as U

# Reasons of a drop; smallest size, most images of a page.
REASONS = ("ui_asset", "promo_asset", "decorative_asset", "duplicate", "brand_story_asset")
TINY, CAP = 96, 16


class SelectionError(ValueError):
    """A selection that doesn't account for its input."""


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def keep_all(images: DataFrame) -> DataFrame:
    return images.select("page_id", "pos", "url", F.lit(True).alias("kept"), _text(None).alias("reason"), _text(None).alias("note"), F.lit(None).cast("long").alias("drop_order"))


def select_by(images: DataFrame, decide: Callable[[Column], Column], note: str = "duplicate image URL") -> DataFrame:
    """The first row of a URL is decided by ``decide`` (struct reason, note; null to keep); repeats are duplicates."""
    nth = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    rows = images.withColumn("nth", nth).withColumn("d", decide(F.col("url")))
    reason = F.when(F.col("nth") > 1, "duplicate").otherwise(F.col("d.reason"))
    why = F.when(F.col("nth") > 1, note).otherwise(F.col("d.note"))
    return rows.select("page_id", "pos", "url", reason.isNull().alias("kept"), reason.alias("reason"), why.alias("note"), F.when(reason.isNotNull(), F.col("pos")).cast("long").alias("drop_order"))


def drop_as(when: Column, reason: str, note: Column | str) -> Column:
    note = F.lit(note) if isinstance(note, str) else note
    return F.when(when, F.struct(F.lit(reason).alias("reason"), note.alias("note")))


def tiny(url: Column, threshold: int = TINY) -> Column:
    """Small resizes of the shopline hosts."""
    size = U.resize(url)
    note = F.concat(F.lit("Shopline tiny resize "), size.cast("long"), F.lit(f"px < {threshold}px threshold"))
    return drop_as(url.rlike(U.SHOPLINE_HOST) & (size < threshold), "decorative_asset", note)


def _fresh(images: DataFrame) -> DataFrame:
    """Rows of a page, or a selection's rows, whose drops stay and take no part in what follows."""
    return images if "kept" in images.columns else keep_all(images)


def _decided(rows: DataFrame, drop: Column, note: Column, order: Column, pos: Column | None = None) -> DataFrame:
    """The selection after another rule's drops; ``stage`` tells which rule dropped a row, as later rules' drops come after."""
    stage = F.col("stage") if "stage" in rows.columns else F.lit(1)
    drop = F.col("kept") & drop
    return rows.select(
        "page_id",
        (F.col("pos") if pos is None else pos).alias("pos"),
        "url",
        (F.col("kept") & ~drop).alias("kept"),
        F.when(drop, "duplicate").otherwise(F.col("reason")).alias("reason"),
        F.when(drop, note).otherwise(F.col("note")).alias("note"),
        F.when(drop, order).otherwise(F.col("drop_order")).cast("long").alias("drop_order"),
        F.when(drop, stage + 1).otherwise(stage).alias("stage"),
    )


def largest_by_id(images: DataFrame) -> DataFrame:
    """Of each image id's resizes the largest stays, the earliest of equal ones; URLs without an id stay.

    A row beaten on arrival names the largest until then; one that was the
    largest names what superseded it, and is dropped when that arrives.
    """
    rows = _fresh(images).withColumn("s", F.when(F.col("kept"), U.sized(F.col("url")))).withColumn("image_id", F.col("s.image_id")).withColumn("size", F.col("s.size"))
    # rows without an id form no group: each is one of its own
    key = F.coalesce("image_id", F.concat(F.lit("\0"), F.col("pos").cast("string")))
    page = Window.partitionBy("page_id", "key").orderBy("pos")
    rows = rows.withColumn("key", key).withColumn("before", F.max("size").over(page.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("record", F.col("before").isNull() | (F.col("size") > F.col("before")))
    among = Window.partitionBy("page_id", "key", "record").orderBy("pos")
    rows = rows.withColumn("next_size", F.when(F.col("record"), F.lead("size").over(among))).withColumn("next_pos", F.when(F.col("record"), F.lead("pos").over(among)))
    beaten = F.when(F.col("record"), F.col("next_size")).otherwise(F.col("before"))
    px = lambda c: c.cast("long").cast("string")
    note = F.concat(F.lit("Shopline image_id "), F.col("image_id"), F.lit(" : "), px(F.col("size")), F.lit("px superseded by "), px(beaten), F.lit("px"))
    return _decided(rows, F.col("image_id").isNotNull() & beaten.isNotNull(), note, F.when(F.col("record"), F.col("next_pos")).otherwise(F.col("pos")))


def shopline(images: DataFrame) -> DataFrame:
    """Exact repeats, then tiny resizes, then all but the largest resize of an image."""
    return largest_by_id(select_by(images, tiny, "exact URL duplicate"))


def one_per_alias(images: DataFrame) -> DataFrame:
    """Of each picture's format aliases the best form stays, at the place of the first."""
    alone = F.concat(F.lit("\0"), F.col("pos").cast("string"))
    rows = _fresh(images).withColumn("key", F.when(F.col("kept"), U.alias_key(F.col("url"))).otherwise(alone)).withColumn("rank", U.alias_rank(F.col("url")))
    best = Window.partitionBy("page_id", "key").orderBy("rank", "pos")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("nth", F.row_number().over(best)).withColumn("preferred", F.first("url").over(whole)).withColumn("place", F.min("pos").over(whole))
    first = F.col("kept") & (F.col("nth") == 1)
    return _decided(rows, F.col("nth") > 1, F.concat(F.lit("BvShop format alias of "), F.col("preferred")), F.col("place"), F.when(first, F.col("place")).otherwise(F.col("pos")))


def bvshop_decision(store_id: str) -> Callable[[Column], Column]:
    def decide(url: Column) -> Column:
        content = url.rlike(U.bvshop_folder(store_id, "product|ckeditor"))
        shared = url.rlike(U.bvshop_folder(store_id, "favicon|logo"))
        other = F.when(shared, F.struct(F.lit("ui_asset").alias("reason"), F.lit("BvShop global asset").alias("note")))
        other = other.when(url.rlike(U.BVSHOP_TEMPLATE), F.struct(F.lit("decorative_asset").alias("reason"), F.lit("BvShop template asset").alias("note")))
        return F.when(~content, other.otherwise(F.struct(F.lit("ui_asset").alias("reason"), F.lit("BvShop non-product image URL").alias("note"))))

    return decide


def bvshop(images: DataFrame, store_id: str) -> DataFrame:
    return one_per_alias(select_by(images, bvshop_decision(store_id)))


def cap(selection: DataFrame, most: int = CAP, reason: str = "brand_story_asset", note: str | None = None) -> DataFrame:
    """The first ``most`` kept rows of a page stay; the rest become drops after all others."""
    if most < 1 or most != int(most):
        raise SelectionError(f"a cap is a whole number of one at least, not {most}")
    nth = F.row_number().over(Window.partitionBy("page_id", "kept").orderBy("pos"))
    over = F.col("kept") & (F.col("nth") > most)
    rows = selection.withColumn("nth", nth)
    return rows.select("page_id", "pos", "url", (F.col("kept") & ~over).alias("kept"), F.when(over, reason).otherwise(F.col("reason")).alias("reason"), F.when(over, note or f"selected image cap {most}").otherwise(F.col("note")).alias("note"), F.when(over, F.col("pos")).otherwise(F.col("drop_order")).cast("long").alias("drop_order"), over.alias("capped"))


def stats(selection: DataFrame, reasons: Sequence[str] = REASONS) -> DataFrame:
    """total, selected, dropped and a count for every reason, zero where it doesn't occur."""
    by_reason = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons]
    return selection.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if("kept").alias("selected"), F.count_if(~F.col("kept")).alias("dropped"), *by_reason)


def audit(images: DataFrame, selection: DataFrame) -> DataFrame:
    """What of a selection isn't accounted for: (page_id, url, unaccounted, outside) counts, no rows if it is sound."""
    a = images.groupBy("page_id", "url").agg(F.count("*").alias("n"))
    b = selection.groupBy("page_id", "url").agg(F.count("*").alias("m"))
    both = a.join(b, ["page_id", "url"], "full").select("page_id", "url", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return both.where("n <> m").select("page_id", "url", F.greatest(F.col("n") - F.col("m"), F.lit(0)).alias("unaccounted"), F.greatest(F.col("m") - F.col("n"), F.lit(0)).alias("outside"))


def validate(images: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection, or SelectionError naming a URL that it lost or made up."""
    bad = audit(images, selection).orderBy(F.desc("outside"), "page_id", "url").limit(1).collect()
    if bad:
        row = bad[0]
        what = "returned a URL outside the discovered images" if row.outside else f"left {row.unaccounted} URL occurrence(s) unaccounted"
        raise SelectionError(f"page {row.page_id}: the selector {what}: {row.url}")
    return selection


# --- contexts of an image in markup -----------------------------------------------------------

# Classes and words of markup that tell what an image is for.
_WORD = lambda w: rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])"
_MOBILE = rf"""(?i)class=["'](?=[^"']*{_WORD("use_main_st_bg")})(?=[^"']*{_WORD("mo|mobile|tp")})[^"']*["']"""
_DECORATIVE = (rf"""(?i)class=["'][^"']*(?:{_WORD("element_img_icon")}|{_WORD("new_pd_bg")})""", rf"""(?i)<video(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])poster=|product_pop""")
_STORY = (rf"""(?i)class=["'][^"']*(?:{_WORD("person_img")}|{_WORD("endorser")})""", "(?i)代言|見證|心得|testimonial")


def context_decision(context: Column) -> Column:
    """Why an image with this markup about it isn't content; null if nothing says so."""
    any_of = lambda rules: context.rlike(rules[0]) | context.rlike(rules[1])
    made = lambda reason, note: F.struct(F.lit(reason).alias("reason"), F.lit(note).alias("note"))
    return F.when(context.rlike(_MOBILE), made("duplicate", "responsive mobile duplicate")).when(any_of(_DECORATIVE), made("decorative_asset", "decorative content image")).when(any_of(_STORY), made("brand_story_asset", "testimonial or storytelling image"))


def context_windows(html: Column, url: Column, radius: int = 900) -> Column:
    """The markup within ``radius`` characters of each place where a spelling of the URL stands.

    Splitting by the spelling leaves the text between its places; a window is the end of
    what precedes a place and the start of what follows.
    """

    def cuts(spelling: Column, parts: Column) -> Column:
        size = F.length(spelling)
        # where each place begins, by one running sum over the parts before it
        first = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("end"))
        step = lambda held, part: F.struct(F.array_append(held["starts"], held["end"] + F.length(part)).alias("starts"), (held["end"] + F.length(part) + size).alias("end"))
        starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), first, step, lambda held: held["starts"])
        return F.transform(starts, lambda s: F.substring(html, F.greatest(s - radius, F.lit(0)) + 1, size + radius + F.least(s, F.lit(radius))))

    def windows(spelling: Column) -> Column:
        parts = F.split(html, F.concat(F.lit(r"\Q"), spelling, F.lit(r"\E")), -1)
        # the parts are computed once
        return F.get(F.transform(F.array(parts), lambda p: cuts(spelling, p)), F.lit(0))

    return F.flatten(F.transform(U.lookup_variants(url), windows))


def html_decision(html: Column, url: Column, radius: int = 260) -> Column:
    """The first verdict of an image's contexts in the page."""
    from storeloom.functions.text import unescape_markup

    verdicts = F.filter(F.transform(context_windows(unescape_markup(html), url, radius), context_decision), lambda v: v.isNotNull())
    return F.get(verdicts, F.lit(0))


def cyberbiz(images: DataFrame, most: int = CAP) -> DataFrame:
    """Rows (page_id, pos, url, html): repeats, then verdicts of the markup, then the cap.

    The markup is judged before rows are shuffled, which then carry its verdict only.
    """
    judged = images.select("page_id", "pos", "url", html_decision(F.col("html"), F.col("url")).alias("d"))
    nth = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    rows = judged.withColumn("nth", nth)
    reason = F.when(F.col("nth") > 1, "duplicate").otherwise(F.col("d.reason"))
    note = F.when(F.col("nth") > 1, "duplicate image URL").otherwise(F.col("d.note"))
    return cap(rows.select("page_id", "pos", "url", reason.isNull().alias("kept"), reason.alias("reason"), note.alias("note"), F.when(reason.isNotNull(), F.col("pos")).cast("long").alias("drop_order")), most)


def unaccounted(images: DataFrame, selection: DataFrame) -> DataFrame:
    """(page_id, url) of the images that a selection leaves out, as often as it does."""
    return images.select("page_id", "url").exceptAll(selection.select("page_id", "url"))
