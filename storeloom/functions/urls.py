"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain

# Hosts and paths of the three storefront engines' image services.
SHOPLINE_HOST = r"(?i)(?:img\.shoplineapp\.com|shoplineimg\.com)"
SHOPLINE_HINT = r"(?i)img\.shoplineapp\.com/media/image_clips/|shoplineimg\.com/"
CYBERBIZ_HINT = r"(?i)cdn(?:-[a-z0-9-]+)?\.cybassets\.com/(?:media|s/files)/"
BVSHOP_TEMPLATE = r"(?i)bvshop\.tw/s_template/"
PLATFORM_HOSTS = (("shopline", SHOPLINE_HOST), ("cyberbiz", r"(?i)cybassets\.com"), ("bvshop", r"(?i)image\.bvshop\.tw"))

# Forms of resized pictures and of format aliases.
_PICTURE = r"(?:jpe?g|png|webp)"
_SIZED = rf"(?i)/(\d+)x\.{_PICTURE}"
_SIZED_ID = rf"(?i)/([a-f0-9]{{20,}})/(\d+)x\.{_PICTURE}"
_ALIAS = r"(?i)\.(jpe?g|png)\.webp(?=\z|[?#])"


def bvshop_folder(store_id: str, folders: str) -> str:
    return rf"(?i)image\.bvshop\.tw/{plain(store_id)}/(?:{folders})/"


def host(url: Column) -> Column:
    """Lower-case host with its port unless that is the scheme's own; null if there is none."""
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    bare = F.regexp_replace(authority, r"\A.*@", "")
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    own = F.when(scheme == "https", F.regexp_replace(bare, r":443\z", "")).otherwise(F.regexp_replace(bare, r":80\z", ""))
    return F.nullif(own, F.lit(""))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")


def product_path_segment(url: Column) -> Column:
    """The path's last part but one, null where there are fewer than two."""
    return F.try_element_at(path_parts(url), F.lit(-2))


def lookup_variants(url: Column) -> Column:
    """The spellings under which markup may hold a URL, each once, in a fixed order."""
    bare = F.regexp_replace(url, r"(?i)\Ahttps:", "")
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    spelled = [url, bare, swap(url, "/", "\\/"), swap(bare, "/", "\\/"), swap(url, "&", "&amp;"), swap(bare, "&", "&amp;")]
    return F.array_distinct(F.array(*spelled))


def sized(url: Column) -> Column:
    """Struct (image_id, size) of a resized picture's URL, null for others."""
    return F.when(url.rlike(_SIZED_ID), F.struct(F.regexp_extract(url, _SIZED_ID, 1).alias("image_id"), F.regexp_extract(url, _SIZED_ID, 2).cast("double").alias("size")))


def resize(url: Column) -> Column:
    """Pixels of the first resize mark of a URL, null without one."""
    return F.nullif(F.regexp_extract(url, _SIZED, 1), F.lit("")).cast("double")


def alias_free(url: Column) -> Column:
    return F.regexp_replace(url, _ALIAS, ".$1")


def alias_key(url: Column) -> Column:
    """What all format aliases of one picture have in common."""
    return F.regexp_replace(alias_free(url), r"(?s)[?#].*\z", "")


def alias_rank(url: Column) -> Column:
    """0 for the plain form; 2 more for a format alias, 1 more for a query or fragment."""
    return url.rlike(_ALIAS).cast("int") * 2 + url.rlike("[?#]").cast("int")


def decoded(component: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and fails on malformed escapes."""
    return F.url_decode(F.replace(component, F.lit("+"), F.lit("%2B")))


def try_decoded(component: Column) -> Column:
    return F.try_url_decode(F.replace(component, F.lit("+"), F.lit("%2B")))


def product_html_path(host_: Column, product_id: Column, quarter: Column, root: str = "data/raw") -> Column:
    return F.concat_ws("/", F.lit(root), host_, quarter, F.lit("products"), F.concat(product_id, F.lit(".html")))


def html_paths(first: Column, fallbacks: Column) -> Column:
    """Where a page may lie, the preferred place first, each once."""
    return F.array_distinct(F.concat(F.array(first), F.coalesce(fallbacks, F.array().cast("array<string>"))))


def sitemap_url(site_url: Column, raw_host: Column) -> Column:
    site = F.coalesce(site_url, F.concat(F.lit("https://"), raw_host))
    return F.concat(F.regexp_replace(site, r"/+\z", ""), F.lit("/sitemap.xml"))


def progress_path(snapshot: Column) -> Column:
    return F.concat(F.regexp_replace(snapshot, r"\.json\z", ""), F.lit(".progress.json"))


def bvshop_slug(url: Column) -> Column:
    """The slug of an item page, whose path is exactly /item/<slug>."""
    parts = path_parts(url)
    return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "item"), F.get(parts, F.lit(1)))


def bvshop_query_url(url: Column) -> Column:
    """Struct (ok, slug, url, code): where an item's data is served, or why there is no such place."""
    slug = bvshop_slug(url)
    scheme, place = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host(url)
    valid = scheme.isNotNull() & place.isNotNull()
    code = F.when(~valid, "INVALID_PRODUCT_URL").when(slug.isNull(), "NOT_BVSHOP_ITEM_URL")
    target = F.when(code.isNull(), F.concat(scheme, F.lit("://"), place, F.lit("/item/query/"), slug))
    return F.struct(code.isNull().alias("ok"), slug.alias("slug"), target.alias("url"), code.alias("code"))


def cookie_header(set_cookies: Column) -> Column:
    """The pairs of Set-Cookie lines as one Cookie header; null without any."""
    from .text import trim_spaces

    pairs = F.transform(set_cookies, lambda c: trim_spaces(F.substring_index(c, ";", 1)))
    return F.nullif(F.array_join(F.filter(pairs, lambda p: p.rlike(r"\A[^=]+=.+")), "; "), F.lit(""))


def component(text: Column) -> Column:
    """Percent-encoding of a URL's component: letters, digits and -_.!~*'() stay, a space is %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for kept, code in (("!", "%21"), ("~", "%7E"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def product_url(site_url: Column, slug: Column, segment: str = "products") -> Column:
    return F.concat_ws("/", F.regexp_replace(site_url, r"/+\z", ""), F.lit(segment.strip("/")), component(slug))
