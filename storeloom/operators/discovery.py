"""Candidate products: checked candidate tables, sitemaps and their walk, slugs, denylists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.lineage import new_folder, written
from storeloom.functions.text import contains_any_pattern
from storeloom.functions.urls import decoded, try_decoded

# Levels below the root; a location in a sitemap.
DEEPEST = 2
_LOC = r"<loc>\s*([^<\s]+)\s*</loc>"


class CandidatesNotFound(LookupError):
    def __init__(self, source: str, quarter: str):
        super().__init__(f"no candidates of {source} for {quarter}")
        self.source, self.quarter = source, quarter


class InvalidCandidate(ValueError):
    def __init__(self, index: int, field: str):
        super().__init__(f"candidate {index} has no {field}")
        self.index, self.field = index, field


class SitemapTooDeep(ValueError):
    pass


def missing_field(url: Column, product_id: Column) -> Column:
    """productUrl before productId; null for a usable row. Empty is missing."""
    absent = lambda c: c.isNull() | (c == "")
    return F.when(absent(url), "productUrl").when(absent(product_id), "productId")


def invalid_candidates(rows: DataFrame) -> DataFrame:
    """Rows (pos, product_url, product_id) that can't be used: index (place by pos, from 0) and field."""
    # the place is a count of smaller positions, asked for the first bad row only
    return rows.withColumn("field", missing_field(F.col("product_url"), F.col("product_id"))).where("field is not null").select("pos", "field")


def load_candidates(rows: DataFrame, source: str = "", quarter: str = "", meta: bool = False) -> DataFrame:
    """Checked rows as (pos, url, product_id[, meta]); the first bad row, or none at all, is an error."""
    first = invalid_candidates(rows).orderBy("pos").limit(1).collect()
    if first:
        raise InvalidCandidate(rows.where(F.col("pos") < first[0].pos).count(), first[0].field)
    if not rows.limit(1).count():
        raise CandidatesNotFound(source, quarter)
    more = ["meta"] if meta else []
    return rows.select("pos", F.col("product_url").alias("url"), "product_id", *more)


def in_memory(spark, rows) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, product_url string, product_id string")


def sitemap_locs(xml: Column) -> Column:
    """Every location of a sitemap as it stands there, repeats included."""
    return F.regexp_extract_all(xml, F.lit(_LOC), F.lit(1))


def split_sitemap(xml: Column) -> Column:
    """Struct (urls, child_sitemaps): an index's locations are sitemaps, all others' are pages."""
    index, locs = xml.rlike(r"<sitemapindex[\s>]"), sitemap_locs(xml)
    none = F.array().cast("array<string>")
    return F.struct(F.when(index, none).otherwise(locs).alias("urls"), F.when(index, locs).otherwise(none).alias("child_sitemaps"))


def product_candidates(urls: DataFrame, pattern: str, strict: bool = True) -> DataFrame:
    """url and product_id (capture 1, decoded) of the URLs that match; malformed escapes fail, or drop the row if not strict."""
    slug = F.regexp_extract("url", pattern, 1)
    rows = urls.where(slug != "").withColumn("product_id", (decoded if strict else try_decoded)(slug))
    return rows if strict else rows.where("product_id is not null")


def first_by_url(rows: DataFrame, *within: str) -> DataFrame:
    """The first row of each URL, in the order of pos."""
    turn = Window.partitionBy(*within, "url").orderBy("pos")
    return rows.withColumn("nth", F.row_number().over(turn)).where("nth = 1").drop("nth")


def walk_sitemaps(sitemaps: DataFrame, root: str, deepest: int = DEEPEST) -> DataFrame:
    """Pages (url, depth, pos) of a sitemap tree in rows (url, xml), each URL once, first place kept.

    A level is a join of the locations with the sitemaps; sitemaps seen before are left
    out, so cycles end. An index below ``deepest`` is an error, as in a crawl. Each level is
    written to the shared folder, so that the next one doesn't run it again.
    """
    spark = sitemaps.sparkSession
    folder = new_folder(spark, "walk")
    order = lambda *c: F.concat_ws("/", *c)
    level = spark.createDataFrame([(root, "")], "url string, pos string")
    seen, pages = level.select("url"), None
    for depth in range(deepest + 2):
        read = written(level.join(sitemaps, "url").select("pos", split_sitemap(F.col("xml")).alias("s")), folder, f"read_{depth}")
        listed = lambda field: read.select("pos", F.posexplode(f"s.{field}").alias("i", "url")).select("url", order(F.col("pos"), F.format_string("%09d", "i")).alias("pos"))  # noqa: B023, E731
        children = listed("child_sitemaps")
        if depth > deepest:
            if level.limit(1).count():
                raise SitemapTooDeep(f"a sitemap lies more than {deepest} levels below {root}")
            break
        found = listed("urls").withColumn("depth", F.lit(depth))
        pages = found if pages is None else pages.unionByName(found)
        level = written(first_by_url(children).join(seen, "url", "left_anti"), folder, f"level_{depth}")
        seen = seen.unionAll(level.select("url"))
    return first_by_url(pages)


def with_prefix(url: Column, prefix: str) -> Column:
    return url.startswith(prefix)


def without_pattern(url: Column, pattern: str) -> Column:
    return ~url.rlike(pattern)


def denylisted(product_id: Column, patterns=None) -> Column:
    return contains_any_pattern(product_id, patterns)


def allowed_entries(entries: DataFrame, patterns=None) -> DataFrame:
    """Entries whose product_id no pattern finds."""
    return entries.where(~denylisted(F.col("product_id"), patterns))
