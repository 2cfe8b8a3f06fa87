"""The registered queries of the storefront operators, each with its SQL twin.

A query applies its operator to whole derived tables; results are flat columns of one
name and type in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.functions import jsonx as J
from storeloom.functions import numbers as N
from storeloom.functions import text as T
from storeloom.functions import urls as U
from storeloom.operators import artifacts as A
from storeloom.operators import discovery, images, observe, ocr, robots
from storeloom.plans import derive as D
from storeloom.plans.derive import derived
from storeloom.sources import model_client, storage
from storeloom.streaming import pacing

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        _QUERIES[name] = f
        _SQL[name] = sql
        return f

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def img(spark, d):
    return derived(spark, d, D.IMAGES)


VOCABULARY = A.Vocabulary(roles=(*A.BASE_ROLES, "datasheet"), preferences={"specs": ("html", "datasheet")})


def classified(spark, d):
    rows = derived(spark, d, D.ARTIFACTS)
    arts = rows.drop("roles_csv")
    cls = rows.where("roles_csv is not null").select("page_id", "pos", "id", F.split("roles_csv", ",").alias("roles"), F.lit(None).cast("string").alias("reason"))
    return arts, cls


_FLAT = ("page_id", "pos", "url", "kept", "reason", "note", "drop_order")


def flat(selection: DataFrame) -> DataFrame:
    return selection.select(*_FLAT)


# --- candidates, sitemaps, robots -------------------------------------------------------------

_CAND = f"with c as ({D.CANDIDATES})"


@query("s03_valid_candidates", f"{_CAND} select pos, product_url as url, product_id from c where coalesce(product_url,'')<>'' and coalesce(product_id,'')<>''")
def s03(spark, d):
    rows = derived(spark, d, D.CANDIDATES)
    return discovery.load_candidates(rows.where(discovery.missing_field(F.col("product_url"), F.col("product_id")).isNull()))


@query("s05_invalid_candidates", f"{_CAND} select pos, case when coalesce(product_url,'')='' then 'productUrl' else 'productId' end as field from c where coalesce(product_url,'')='' or coalesce(product_id,'')=''")
def s05(spark, d):
    return discovery.invalid_candidates(derived(spark, d, D.CANDIDATES))


_XML = f"with x as ({D.SITEMAPS})"
_LOCS = r"regexp_extract_all(xml, '<loc>\s*([^<\s]+)\s*</loc>', 1)"


@query("s06_sitemap_locs", f"{_XML} select page_id, unnest(range(len({_LOCS}))) as pos, unnest({_LOCS}) as loc from x")
def s06(spark, d):
    return derived(spark, d, D.SITEMAPS).select("page_id", F.posexplode(discovery.sitemap_locs(F.col("xml"))).alias("pos", "loc")).withColumn("pos", F.col("pos").cast("long"))


@query("s07_sitemap_split", f"{_XML} select page_id, case when xml like '%<sitemapindex>%' then '' else array_to_string({_LOCS}, ' ') end as urls, case when xml like '%<sitemapindex>%' then array_to_string({_LOCS}, ' ') else '' end as children from x")
def s07(spark, d):
    s = derived(spark, d, D.SITEMAPS).withColumn("s", discovery.split_sitemap(F.col("xml")))
    return s.select("page_id", F.array_join("s.urls", " ").alias("urls"), F.array_join("s.child_sitemaps", " ").alias("children"))


_WALK = rf"""with recursive t as ({D.TREE_DUCK}), l as (select url as parent, xml like '%<sitemapindex>%' as is_index, unnest({_LOCS}) as url from t),
 r as (select 'https://s.test/0' as url, 0 as depth union select l.url, r.depth + 1 from r join l on l.parent = r.url where l.is_index)
 select l.url, min(r.depth) as depth from r join l on l.parent = r.url where not l.is_index group by 1"""


@query("s08_sitemap_walk", _WALK)
def s08(spark, d):
    return discovery.walk_sitemaps(derived(spark, d, D.TREE_SPARK), "https://s.test/0").select("url", "depth")


@query("s09_product_slugs", f"{_XML}, u as (select page_id, unnest({_LOCS}) as url from x where page_id % 10 <> 0) select page_id, url, url_decode(regexp_extract(url, '/products/([^/?#]+)', 1)) as product_id from u where regexp_extract(url, '/products/([^/?#]+)', 1) <> ''")
def s09(spark, d):
    urls = derived(spark, d, D.SITEMAPS).select("page_id", F.explode(discovery.sitemap_locs(F.col("xml"))).alias("url"))
    return discovery.product_candidates(urls, "/products/([^/?#]+)")


@query("s13_html_paths", "select page_id, concat('data/raw/h', cast(page_id % 4 as string), '/2026-Q3/products/p', cast(page_id as string), '.html') as path from pages")
def s13(spark, d):
    pages = D.table(spark, d, "pages")
    key = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return pages.select("page_id", U.product_html_path(key("h", F.col("page_id") % 4), key("p", F.col("page_id")), F.lit("2026-Q3")).alias("path"))


@query("s14_path_choices", "select page_id, concat('a', cast(page_id % 3 as string), case when page_id % 3 <> 1 then ' a1' else '' end, ' b') as paths from pages")
def s14(spark, d):
    first = F.concat(F.lit("a"), (F.col("page_id") % 3).cast("string"))
    paths = U.html_paths(first, F.array(F.lit("a1"), F.lit("b"), F.lit("a1")))
    return D.table(spark, d, "pages").select("page_id", F.array_join(paths, " ").alias("paths"))


@query("s15_path_fallback", "select 'p' || page_id as product_id, case when page_id % 3 = 0 then 'a/' || page_id when page_id % 3 = 1 then 'b/' || page_id end as path from pages")
def s15(spark, d):
    pages = D.table(spark, d, "pages").withColumn("n", F.col("page_id").cast("string"))
    at = lambda p: F.concat(F.lit(p), F.col("n"))
    stored = pages.where("page_id % 3 = 0").select(at("a/").alias("path"), "html").unionAll(pages.where("page_id % 3 <> 2").select(at("b/").alias("path"), "html"))
    wanted = pages.select(at("p").alias("product_id"), F.array(at("a/"), at("b/")).alias("paths"))
    return storage.first_stored(wanted, stored).select("product_id", "path")


@query("f01_prefix", "select page_id, url from pages where starts_with(url, 'https://')")
def f01(spark, d):
    return D.table(spark, d, "pages").where(discovery.with_prefix(F.col("url"), "https://")).select("page_id", "url")


@query("f02_exclude", "select page_id, url from pages where not regexp_matches(url, '[?#]')")
def f02(spark, d):
    return D.table(spark, d, "pages").where(discovery.without_pattern(F.col("url"), "[?#]")).select("page_id", "url")


@query("f03_denylist", f"{_CAND} select pos, product_id from c where product_id is not null and not (regexp_matches(product_id, '^p1') or regexp_matches(product_id, '7$'))")
def f03(spark, d):
    return discovery.allowed_entries(derived(spark, d, D.CANDIDATES).where("product_id is not null"), ["^p1", r"7\z"]).select("pos", "product_id")


_RULE_ROWS = ", ".join(f"('{k}', '{p}')" for k, p in D.RULES)


@query("f05_robots_parse", rf"""with f as ({D.ROBOTS_DUCK}), l as (select page_id, unnest(string_split_regex(text, '\r?\n')) as raw, unnest(range(len(string_split_regex(text, '\r?\n')))) as line from f),
 t as (select page_id, line, trim(regexp_replace(raw, '#.*$', '')) as t from l), k as (select page_id, line, lower(trim(split_part(t, ':', 1))) as key, trim(substr(t, instr(t, ':') + 1)) as value from t where instr(t, ':') > 1),
 g as (select *, last_value(case when key = 'user-agent' then value end ignore nulls) over (partition by page_id order by line rows between unbounded preceding and current row) as agent from k)
 select page_id, line, case when key = 'sitemap' then 'sitemap' when key = 'disallow' and regexp_matches(value, '\*.|\$$') then 'unsupported' else key end as kind, value as pattern from g
 where value <> '' and (key = 'sitemap' or (agent = '*' and (key = 'disallow' or (key = 'allow' and not regexp_matches(value, '\*.|\$$')))))""")
def f05(spark, d):
    files = derived(spark, d, D.ROBOTS_SPARK).withColumnRenamed("page_id", "host")
    return robots.parse(files).select(F.col("host").alias("page_id"), F.col("line").cast("long").alias("line"), "kind", "pattern")


@query(
    "f06_robots_disallowed",
    f"with p as ({D.PATHS}), r(kind, pattern) as (values {_RULE_ROWS}), m as (select p.page_id, p.path, max(case when kind <> 'allow' then length(pattern) else 0 end) as deny, max(case when kind = 'allow' then length(pattern) else 0 end) as allow from p join r on starts_with(p.path, string_split(pattern, '*')[1]) group by 1, 2) select p.page_id, p.path, coalesce(deny > allow, false) as disallowed from p left join m on p.page_id = m.page_id",
)
def f06(spark, d):
    rules = spark.createDataFrame([("h", k, p) for k, p in D.RULES], "host string, kind string, pattern string")
    return robots.disallowed(derived(spark, d, D.PATHS), rules).select("page_id", "path", "disallowed")


# --- images ---------------------------------------------------------------------------------------

_IMG = f"with i as ({D.IMAGES})"


@query("f07_image_attribution", f"{_IMG} select page_id, pos, case when regexp_matches(url, '(?i)img\\.shoplineapp\\.com/media/image_clips/|shoplineimg\\.com/') then 'shopline' when regexp_matches(url, '(?i)cdn(-[a-z0-9-]+)?\\.cybassets\\.com/(media|s/files)/') then 'cyberbiz' when regexp_matches(url, '(?i)image\\.bvshop\\.tw/42/(product|ckeditor)/') then 'bvshop' end as source from i")
def f07(spark, d):
    u = F.col("url")
    source = F.when(u.rlike(U.SHOPLINE_HINT), "shopline").when(u.rlike(U.CYBERBIZ_HINT), "cyberbiz").when(u.rlike(U.bvshop_folder("42", "product|ckeditor")), "bvshop")
    return img(spark, d).select("page_id", "pos", source.alias("source"))


@query("f08_tiny", f"{_IMG} select page_id, pos, 'Shopline tiny resize ' || regexp_extract(url, '/([0-9]+)x\\.', 1) || 'px < 96px threshold' as note from i where url like '%shoplineimg.com%' and try_cast(regexp_extract(url, '/([0-9]+)x\\.(jpe?g|png|webp)', 1) as int) < 96")
def f08(spark, d):
    return img(spark, d).withColumn("d", images.tiny(F.col("url"))).where("d is not null").select("page_id", "pos", "d.note")


_EXACT = _IMG + ", n as (select *, row_number() over (partition by page_id, url order by pos) as nth from i)"


@query("w01_exact_dedupe", f"{_EXACT} select page_id, pos, url, nth = 1 as kept, case when nth > 1 then 'duplicate' end as reason, case when nth > 1 then 'duplicate image URL' end as note, case when nth > 1 then pos end as drop_order from n")
def w01(spark, d):
    return flat(images.select_by(img(spark, d), lambda u: images.drop_as(F.lit(False), "ui_asset", "")))


_SIZE = "try_cast(regexp_extract(url, '/[a-f0-9]{20,}/([0-9]+)x\\.jpg', 1) as int)"
_CHAIN = """, {src}, s as (select *, {size} as size, nullif(regexp_extract(url, '/([a-f0-9]{{20,}})/[0-9]+x\\.jpg', 1), '') as image_id from {name}),
b as (select *, max(size) over (partition by page_id, image_id order by pos rows between unbounded preceding and 1 preceding) as before from s),
r as (select *, image_id is not null and (before is null or size > before) as rec from b),
x as (select *, case when rec then lead(size) over (partition by page_id, image_id, rec order by pos) end as next_size, case when rec then lead(pos) over (partition by page_id, image_id, rec order by pos) end as next_pos from r),
y as (select page_id, pos, url, image_id, size, case when image_id is null then null when rec then next_size else before end as beaten, case when rec then next_pos else pos end as place from x),
z as (select page_id, pos, url, beaten is null as kept, case when beaten is not null then 'duplicate' end as reason, case when beaten is not null then 'Shopline image_id ' || image_id || ' : ' || size || 'px superseded by ' || beaten || 'px' end as note, case when beaten is not null then place end as drop_order from y)"""


def _chain(src: str, name: str) -> str:
    return _CHAIN.format(src=src, size=_SIZE, name=name)


_UNIQUE = "u as (select page_id, pos, url from n where nth = 1)"


@query("w02_shopline_dedupe", _EXACT + _chain(_UNIQUE, "u") + " select page_id, pos, url, kept, reason, note, drop_order from z")
def w02(spark, d):
    first = images.select_by(img(spark, d), lambda u: images.drop_as(F.lit(False), "ui_asset", "")).where("kept").select("page_id", "pos", "url")
    return flat(images.largest_by_id(first))


_TINY = "t as (select *, case when url like '%shoplineimg.com%' and try_cast(regexp_extract(url, '/([0-9]+)x\\.jpg', 1) as int) < 96 then 'Shopline tiny resize ' || regexp_extract(url, '/([0-9]+)x\\.jpg', 1) || 'px < 96px threshold' end as tiny from n), u as (select page_id, pos, url from t where nth = 1 and tiny is null)"
_SHOPLINE = _EXACT + _chain(_TINY, "u") + ", sel as (select page_id, pos, url, kept, reason, note, drop_order from z union all select page_id, pos, url, false, case when nth > 1 then 'duplicate' else 'decorative_asset' end, case when nth > 1 then 'exact URL duplicate' else tiny end, pos from t where nth > 1 or tiny is not null)"


@query("w04_shopline_select", f"{_SHOPLINE} select page_id, pos, url, kept, reason, note, drop_order from sel")
def w04(spark, d):
    return flat(images.shopline(img(spark, d)))


_STATS = "select page_id, count(*) as total, count(*) filter (kept) as selected, count(*) filter (not kept) as dropped, " + ", ".join(f"count(*) filter (reason = '{r}') as n_{r}" for r in images.REASONS) + " from sel group by page_id"


@query("w04_shopline_stats", f"{_SHOPLINE} {_STATS}")
def w04_stats(spark, d):
    return images.stats(images.shopline(img(spark, d)))


_BV_DECIDED = _EXACT + """, q as (select *, case when nth > 1 then 'duplicate' when regexp_matches(url, '(?i)image\\.bvshop\\.tw/42/(product|ckeditor)/') then null when regexp_matches(url, '(?i)image\\.bvshop\\.tw/42/(favicon|logo)/') then 'ui_asset' when url like '%bvshop.tw/s_template/%' then 'decorative_asset' else 'ui_asset' end as reason,
 case when nth > 1 then 'duplicate image URL' when regexp_matches(url, '(?i)image\\.bvshop\\.tw/42/(product|ckeditor)/') then null when regexp_matches(url, '(?i)image\\.bvshop\\.tw/42/(favicon|logo)/') then 'BvShop global asset' when url like '%bvshop.tw/s_template/%' then 'BvShop template asset' else 'BvShop non-product image URL' end as note from n),
 k as (select page_id, pos, url, regexp_replace(regexp_replace(url, '\\.jpg\\.webp($|[?#])', '.jpg\\1'), '[?#].*$', '') as key, (case when regexp_matches(url, '\\.jpg\\.webp($|[?#])') then 2 else 0 end + case when regexp_matches(url, '[?#]') then 1 else 0 end) as rank from q where reason is null),
 g as (select *, row_number() over (partition by page_id, key order by rank, pos) as turn, first_value(url) over (partition by page_id, key order by rank, pos) as best, min(pos) over (partition by page_id, key) as place from k),
 sel as (select page_id, case when turn = 1 then place else pos end as pos, url, turn = 1 as kept, case when turn > 1 then 'duplicate' end as reason, case when turn > 1 then 'BvShop format alias of ' || best end as note, case when turn > 1 then place end as drop_order from g union all select page_id, pos, url, false, reason, note, pos from q where reason is not null)"""


@query("f09_bv_decision", _BV_DECIDED + " select page_id, pos, reason, note from q")
def f09(spark, d):
    return images.select_by(img(spark, d), images.bvshop_decision("42")).select("page_id", "pos", "reason", "note")


@query("w03_bv_alias", _BV_DECIDED + " select page_id, pos, url, kept, reason, note, drop_order from sel")
def w03(spark, d):
    return flat(images.bvshop(img(spark, d), "42"))


_CAPPED = _EXACT + ", c as (select *, row_number() over (partition by page_id, nth = 1 order by pos) as turn from n) select page_id, pos, url, nth = 1 and turn <= 16 as kept, case when nth > 1 then 'duplicate' when turn > 16 then 'brand_story_asset' end as reason, case when nth > 1 then 'duplicate image URL' when turn > 16 then 'selected image cap 16' end as note from c"


@query("w07_cap", _CAPPED)
def w07(spark, d):
    first = images.select_by(img(spark, d), lambda u: images.drop_as(F.lit(False), "ui_asset", ""))
    return images.cap(first).select("page_id", "pos", "url", "kept", "reason", "note")


@query("j06_selection_audit", f"{_IMG} select page_id, url, count(*) as unaccounted, cast(0 as bigint) as outside from i where pos % 13 = 0 group by page_id, url")
def j06(spark, d):
    rows = img(spark, d)
    return images.audit(rows, images.keep_all(rows).where("pos % 13 <> 0"))


@query("x04_except_all", f"{_IMG} select page_id, url from i except all select page_id, url from i where pos % 13 <> 0")
def x04(spark, d):
    rows = img(spark, d)
    return images.unaccounted(rows, rows.where("pos % 13 <> 0"))


@query("a02_drop_counts", f"{_BV_DECIDED} {_STATS}")
def a02(spark, d):
    return images.stats(images.bvshop(img(spark, d), "42"))


_CTX = f"with c as ({D.CONTEXTS})"
_CLASS = "regexp_extract(context, 'class=\"([^\"]*)\"', 1)"


@query("f10_context_rules", f"{_CTX}, k as (select doc_id, context, ' ' || {_CLASS} || ' ' as cls from c) select doc_id, case when cls like '% use_main_st_bg %' and (cls like '% mobile %' or cls like '% mo %' or cls like '% tp %') then 'duplicate' when cls like '% element_img_icon %' or cls like '% new_pd_bg %' then 'decorative_asset' when cls like '% person_img %' or cls like '% endorser %' or regexp_matches(context, '(?i)代言|見證|心得|testimonial') then 'brand_story_asset' end as reason from k")
def f10(spark, d):
    rows = derived(spark, d, D.CONTEXTS)
    return rows.select("doc_id", images.context_decision(F.col("context"))["reason"].alias("reason"))


_ABOUT = """(?i)class=["'][^"']*\\b"""
_WHY = rf"""case when regexp_matches(w, '{_ABOUT.replace("'", "''")}use_main_st_bg\b[^"'']*\b(mo|mobile|tp)\b') or regexp_matches(w, '{_ABOUT.replace("'", "''")}(mo|mobile|tp)\b[^"'']*\buse_main_st_bg\b') then 'duplicate'
 when regexp_matches(w, '{_ABOUT.replace("'", "''")}(element_img_icon|new_pd_bg)\b') or regexp_matches(w, '(?i)<video\b[^>]*\bposter=|product_pop') then 'decorative_asset'
 when regexp_matches(w, '{_ABOUT.replace("'", "''")}(person_img|endorser)\b') or regexp_matches(w, '(?i)代言|見證|心得|testimonial') then 'brand_story_asset' end"""


def _contexts(rows: str) -> str:
    """CTEs that end in c (page_id, url, reason): the verdict of the markup within 260 characters of each spelling of a URL; rows: a CTE body (page_id, url, html)."""
    return rf"""w0 as ({rows}), w1 as (select page_id, url, replace(replace(html, '&amp;', '&'), '\/', '/') as html, regexp_replace(url, '^(?i)https:', '') as b from w0),
 w2 as (select page_id, url, html, unnest([url, b, replace(url,'/','\/'), replace(b,'/','\/'), replace(url,'&','&amp;'), replace(b,'&','&amp;')]) as v, unnest([1,2,3,4,5,6]) as nth from w1),
 w3 as (select page_id, url, any_value(html) as html, v, min(nth) as nth from w2 group by page_id, url, v),
 w4 as (select page_id, url, html, v, nth, string_split(html, v) as parts from w3),
 w5 as (select page_id, url, html, v, nth, unnest(range(1, len(parts))) as k, parts from w4),
 w6 as (select page_id, url, nth, k, html, v, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(v) as s from w5),
 w7 as (select page_id, url, nth, k, substr(html, cast(greatest(s - 260, 0) + 1 as bigint), cast(length(v) + 260 + least(s, 260) as bigint)) as w from w6),
 w8 as (select page_id, url, nth, k, {_WHY} as reason from w7), c as (select page_id, url, arg_min(reason, nth * 1000000 + k) filter (reason is not null) as reason from w8 group by 1, 2)"""


@query("f11_html_context", f"with {_contexts(f'select page_id, unnest([' + chr(39) + 'https://cdn.cybassets.com/media/' + chr(39) + ' || page_id || ' + chr(39) + '.png?a=1&b=2' + chr(39) + ', ' + chr(39) + 'https://cdn-ap.cybassets.com/s/files/' + chr(39) + ' || (page_id % 7) || ' + chr(39) + '.jpg' + chr(39) + f']) as url, html from ({D.MARKED})')} select page_id, url, reason from c")
def f11(spark, d):
    n = F.col("page_id")
    urls = F.array(F.concat(F.lit("https://cdn.cybassets.com/media/"), n.cast("string"), F.lit(".png?a=1&b=2")), F.concat(F.lit("https://cdn-ap.cybassets.com/s/files/"), (n % 7).cast("string"), F.lit(".jpg")))
    rows = derived(spark, d, D.MARKED).withColumn("url", F.explode(urls))
    return rows.select("page_id", "url", images.html_decision(F.col("html"), F.col("url"))["reason"].alias("reason"))


_MARKED_IMAGES = f"m as ({D.MARKED}), i as (select page_id, unnest(range(len(u))) as pos, unnest(u) as raw, html from (select page_id, html, regexp_extract_all(html, '(?i)<img[^>]+(?:src|data-src)=[\"''](https?://[^\"'']+)[\"''][^>]*>', 1) as u from m)), j as (select page_id, pos, replace(raw, '&amp;', '&') as url, html from i)"


@query("p05_cyberbiz", f"with {_MARKED_IMAGES}, {_contexts('select distinct page_id, url, html from j')}, n as (select page_id, pos, url, row_number() over (partition by page_id, url order by pos) as nth from j), e as (select n.*, case when nth > 1 then 'duplicate' else c.reason end as why from n left join c on c.page_id = n.page_id and c.url = n.url), f as (select *, row_number() over (partition by page_id, why is null order by pos) as turn from e) select page_id, pos, url, why is null and turn <= 2 as kept, case when why is null and turn > 2 then 'brand_story_asset' else why end as reason, case when why is null and turn > 2 then 'selected image cap 2' when nth > 1 then 'duplicate image URL' when why = 'duplicate' then 'responsive mobile duplicate' when why = 'decorative_asset' then 'decorative content image' when why = 'brand_story_asset' then 'testimonial or storytelling image' end as note, case when why is not null or turn > 2 then pos end as drop_order from f")
def p05(spark, d):
    rows = derived(spark, d, D.MARKED).select("page_id", "html", F.posexplode(observe.image_urls(F.col("html"))).alias("pos", "raw"))
    rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), T.artifact_url(F.col("raw")).alias("url"), "html")
    return flat(images.cyberbiz(rows, 2))


@query("c03_sized_url", f"{_IMG} select page_id, pos, nullif(regexp_extract(url, '/([a-f0-9]{{20,}})/[0-9]+x\\.jpg', 1), '') as image_id, cast({_SIZE} as double) as size from i")
def c03(spark, d):
    s = U.sized(F.col("url"))
    return img(spark, d).select("page_id", "pos", s["image_id"].alias("image_id"), s["size"].alias("size"))


@query("c04_alias_key", _BV_DECIDED + " select page_id, pos, key, cast(rank as integer) as rank from k")
def c04(spark, d):
    kept = images.select_by(img(spark, d), images.bvshop_decision("42")).where("kept")
    return kept.select("page_id", "pos", U.alias_key(F.col("url")).alias("key"), U.alias_rank(F.col("url")).alias("rank"))


# --- pages ------------------------------------------------------------------------------------------

_PG = f"with p as ({D.PAGES})"
_URLS = "regexp_extract_all(html, '(?i)<img[^>]+(?:src|data-src)=[\"''](https?://[^\"'']+)[\"''][^>]*>', 1)"
_IMGS = _PG + f", u as (select page_id, url as page_url, unnest({_URLS}) as url, unnest(range(len({_URLS}))) as pos from p)"
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


def pages(spark, d):
    return derived(spark, d, D.PAGES)


def page_images(spark, d):
    return pages(spark, d).select("page_id", F.posexplode(observe.image_urls(F.col("html"))).alias("pos", "url"))


@query("c09_img_urls", f"{_IMGS} select page_id, pos, url from u")
def c09(spark, d):
    return page_images(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query("a01_image_hosts", f"{_IMGS} select page_id, {_HOST} as host, count(*) as n from u group by 1, 2")
def a01(spark, d):
    return observe.host_counts(page_images(spark, d))


@query("o05_topk_hosts", f"{_IMGS}, h as (select page_id, {_HOST} as host, count(*) as n from u group by 1, 2) select page_id, host, n, row_number() over (partition by page_id order by n desc, host) as rank from h qualify rank <= 8")
def o05(spark, d):
    return observe.top_hosts(page_images(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("a08_lazy_count", f"{_PG} select page_id, cast(len(regexp_extract_all(html, '(?i)<img[^>]+data-src=[\"'']https?://[^\"'']+[\"'']')) as bigint) as n from p")
def a08(spark, d):
    return pages(spark, d).select("page_id", observe.lazy_images(F.col("html")).alias("n"))


_PRODUCT = """len(list_filter(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: regexp_matches(b, '(?i)"@type"\\s*:\\s*"?\\[?\\s*"?Product'))) > 0"""
_PARTS = "list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


@query("c10_jsonld", f"{_PG} select page_id, {_PRODUCT} as product from p")
def c10(spark, d):
    return pages(spark, d).select("page_id", observe.has_product_data(F.col("html")).alias("product"))


@query("c11_path_segment", f"{_PG} select page_id, {_PARTS}[-2] as segment from p")
def c11(spark, d):
    return pages(spark, d).select("page_id", U.product_path_segment(F.col("url")).alias("segment"))


_LABEL = "(?i)(nutrition|supplement|ingredient|spec|facts|label)[-_]?[a-z0-9]*\\.(jpe?g|png|webp)"
_LABELS = f"select page_id, string_agg(name, ' ' order by name) as labels from (select distinct page_id, string_split(url, '/')[-1] as name from u) where regexp_matches(name, '{_LABEL}') group by 1"


@query("c12_labels", f"{_IMGS} {_LABELS}")
def c12(spark, d):
    rows = pages(spark, d).select("page_id", F.array_join(observe.label_files(observe.image_urls(F.col("html"))), " ").alias("labels"))
    return rows.where("labels <> ''")


_SEEN = f"""{_IMGS}, h as (select page_id, {_HOST} as host, count(*) as n from u group by 1, 2),
 k as (select page_id, string_agg(host, ', ' order by n desc, host) filter (regexp_matches(host, 'img.shoplineapp.com|shoplineimg.com')) as shopline, string_agg(host, ', ' order by n desc, host) filter (contains(host, 'cybassets.com')) as cyberbiz, string_agg(host, ', ' order by n desc, host) filter (contains(host, 'image.bvshop.tw')) as bvshop, string_agg(host || ':' || n, ' ' order by n desc, host) as hosts from h group by 1),
 l as ({_LABELS}),
 o as (select p.page_id, p.url, case when shopline is not null then 'shopline' when cyberbiz is not null then 'cyberbiz' when bvshop is not null then 'bvshop' else 'custom' end as kind,
  case when shopline is not null then ['image host ' || shopline] when cyberbiz is not null then ['image host ' || cyberbiz] when bvshop is not null then case when contains(p.url, '/item/') then ['image host ' || bvshop, 'product path /item/'] else ['image host ' || bvshop] end else [] end as evidence,
  coalesce(hosts, '') as hosts, {_PRODUCT} as product, {_PARTS.replace("url", "p.url")}[-2] as segment, coalesce(labels, '') as labels, cast(len(regexp_extract_all(html, '(?i)<img[^>]+data-src=["'']https?://[^"'']+["'']')) as bigint) as lazy
  from p left join k on k.page_id = p.page_id left join l on l.page_id = p.page_id)"""


@query("j05_platform", f"{_SEEN} select page_id, kind, array_to_string(evidence, '; ') as evidence from o")
def j05(spark, d):
    hosts = observe.image_hosts(observe.image_urls(F.col("html")))
    return pages(spark, d).withColumn("p", observe.platform(hosts, F.col("url"))).select("page_id", "p.kind", F.array_join("p.evidence", "; ").alias("evidence"))


@query("c27_method", f"{_SEEN} select page_id, case when not product then 'html-direct' when kind in ('shopline', 'cyberbiz') then kind || '-jsonld-llm' else 'sitemap-jsonld' end as method from o")
def c27(spark, d):
    obs = observe.observe(pages(spark, d))
    return obs.select("page_id", observe.suggested_method(F.col("has_product_data"), F.col("platform.kind")).alias("method"))


_ADVICE = """select page_id, case kind when 'custom' then 'custom_commerce_platform' else 'define_' || kind || '_source' end as symbol, case kind when 'custom' then 'its images come from hosts of no engine that is known here' else kind || ' serves this site: ' || array_to_string(evidence, ', ') end as because from o
 union all select page_id, 'label_image', len(string_split(labels, ' ')) || ' image names speak of a label, the first is ' || split_part(labels, ' ', 1) from o where labels <> ''
 union all select page_id, 'select_by', 'images loaded late: ' || lazy from o where lazy > 0
 union all select page_id, 'read_product_html', 'the page declares no product of its own' from o where not product"""


@query("c28_suggestions", f"{_SEEN} {_ADVICE}")
def c28(spark, d):
    return observe.suggestions(observe.observe(pages(spark, d))).select("page_id", "symbol", "because")


@query("j08_suggestion_summaries", f"{_SEEN}, a as ({_ADVICE}), s as (select * from (values ('select_by', 'Which images stay.'), ('read_product_html', 'Stored pages.'), ('read_product_html', 'Pages.')) as t(symbol, summary)), m as (select symbol, min(summary) as summary from s group by 1) select a.page_id, a.symbol, coalesce(m.summary, '') as summary from a left join m on m.symbol = a.symbol")
def j08(spark, d):
    known = spark.createDataFrame([("select_by", "Which images stay."), ("read_product_html", "Stored pages."), ("read_product_html", "Pages.")], "symbol string, summary string")
    return observe.suggestions(observe.observe(pages(spark, d)), known).select("page_id", "symbol", "summary")


@query("p02_observe", f"{_SEEN} select page_id, url, kind, hosts, product, segment, labels, lazy from o")
def p02(spark, d):
    o = observe.observe(pages(spark, d))
    hosts = F.array_join(F.transform("image_hosts", lambda h: F.concat(h["host"], F.lit(":"), h["count"].cast("string"))), " ")
    return o.select("page_id", "url", "platform.kind", hosts.alias("hosts"), F.col("has_product_data").alias("product"), F.col("product_path_segment").alias("segment"), F.array_join("label_images", " ").alias("labels"), F.col("lazy_images").alias("lazy"))


@query("o01_carousel", f"{_IMGS}, f as (select page_id, url, min(pos) as pos from u group by 1, 2) select page_id, string_agg(url, ' ' order by coalesce(try_cast(regexp_extract(url, '-([0-9]+)-', 1) as bigint), -1), pos) as slides from f group by 1")
def o01(spark, d):
    return pages(spark, d).select("page_id", F.array_join(observe.slides(F.col("html")), " ").alias("slides")).where("slides <> ''")


@query("o06_label", f"{_IMGS} select page_id, min_by(url, pos) as label from u where regexp_matches(url, '(?i)(nutrition|supplement|ingredient|spec)[-_]?(facts|sheet|s)?') group by 1")
def o06(spark, d):
    return pages(spark, d).select("page_id", observe.label_image(F.col("html")).alias("label")).where("label is not null")


@query("u13_slides_of_a_site", f"{_IMGS}, f as (select page_id, url, min(pos) as pos from u where regexp_matches(url, '//b\\.test/') group by 1, 2), s as (select page_id, string_agg(url, ' ' order by coalesce(try_cast(regexp_extract(url, 'x-([0-9]+)', 1) as bigint), -1), pos) as slides from f group by 1), l as (select page_id, min_by(url, pos) as label from u where regexp_matches(url, '(?i)specifications\\.') group by 1) select p.page_id, coalesce(slides, '') as slides, label from p left join s on s.page_id = p.page_id left join l on l.page_id = p.page_id")
def u13(spark, d):
    html = F.col("html")
    return pages(spark, d).select("page_id", F.array_join(observe.slides(html, "//b\\.test/", r"x-(\d+)"), " ").alias("slides"), observe.label_image(html, r"(?i)specifications\.").alias("label"))


@query("o08_top_host", f"{_IMGS}, h as (select page_id, {_HOST} as host, count(*) as n from u group by 1, 2) select page_id, host from h qualify row_number() over (partition by page_id order by n desc, host) = 1")
def o08(spark, d):
    hosts = observe.image_hosts(observe.image_urls(F.col("html")))
    return pages(spark, d).select("page_id", F.get(hosts, F.lit(0))["host"].alias("host")).where("host is not null")


@query("w05_distinct_first", "with u as (select page_id as pos, regexp_replace(url, '[?#].*$', '') as url from pages) select min(pos) as pos, url from u group by url")
def w05(spark, d):
    rows = D.table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.regexp_replace("url", r"[?#].*\z", "").alias("url"))
    return discovery.first_by_url(rows).select("pos", "url")


@query("c01_normalize_url", r"select page_id, case when regexp_matches(trim(raw), '(?i)^https?://') then trim(raw) end as url from (select page_id, replace(replace(case when page_id % 3 = 0 then '  ' || replace(url, '&', '&amp;') || ' ' when page_id % 3 = 1 then replace(url, '/', '\/') else 'x' || url end, '&amp;', '&'), '\/', '/') as raw from pages)")
def c01(spark, d):
    n, u = F.col("page_id"), F.col("url")
    raw = F.when(n % 3 == 0, F.concat(F.lit("  "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" "))).when(n % 3 == 1, F.replace(u, F.lit("/"), F.lit("\\/"))).otherwise(F.concat(F.lit("x"), u))
    return D.table(spark, d, "pages").select("page_id", T.artifact_url(raw).alias("url"))


@query("c07_variants", r"with v as (select page_id, url, regexp_replace(url, '^https:', '') as b from pages), a as (select page_id, unnest([url, b, replace(url,'/','\/'), replace(b,'/','\/'), replace(url,'&','&amp;'), replace(b,'&','&amp;')]) as variant, unnest([1,2,3,4,5,6]) as nth from v), f as (select page_id, variant, min(nth) as nth from a group by 1, 2) select page_id, string_agg(variant, ' ' order by nth) as variants from f group by 1")
def c07(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.array_join(U.lookup_variants(F.col("url")), " ").alias("variants"))


@query("c13_host", "select page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), ':80$', '')) as host from pages")
def c13(spark, d):
    return D.table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query("c14_bv_slug", f"{_PG} select page_id, case when len({_PARTS}) = 2 and {_PARTS}[1] = 'item' then {_PARTS}[2] end as slug from p")
def c14(spark, d):
    return pages(spark, d).select("page_id", U.bvshop_slug(F.col("url")).alias("slug"))


@query("c15_bv_query_url", f"{_PG}, q as (select page_id, case when page_id % 7 = 0 then html else url end as url from p), r as (select page_id, regexp_matches(url, '^https?://[^/?#]') as valid, case when len({_PARTS}) = 2 and {_PARTS}[1] = 'item' then {_PARTS}[2] end as slug, regexp_extract(url, '^https?://[^/?#]+') as origin from q) select page_id, valid and slug is not null as ok, case when valid and slug is not null then origin || '/item/query/' || slug end as url, case when not valid then 'INVALID_PRODUCT_URL' when slug is null then 'NOT_BVSHOP_ITEM_URL' end as code from r")
def c15(spark, d):
    url = F.when(F.col("page_id") % 7 == 0, F.col("html")).otherwise(F.col("url"))
    return pages(spark, d).withColumn("r", U.bvshop_query_url(url)).select("page_id", "r.ok", "r.url", "r.code")


@query("c16_cookies", "select page_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(url, '[/?]'), lambda x: trim(split_part(x, '&', 1))), lambda x: regexp_matches(x, '^[^=]+=.')), '; '), '') as cookie from (select page_id, url || '?a=1&Path=/b=/ c=x=y &z' as url from pages)")
def c16(spark, d):
    lines = F.split(F.concat("url", F.lit("?a=1&Path=/b=/ c=x=y &z")), "[/?]")
    return D.table(spark, d, "pages").select("page_id", U.cookie_header(F.transform(lines, lambda x: F.replace(x, F.lit("&"), F.lit(";")))).alias("cookie"))


@query("c17_sitemap_url", "select page_id, case when page_id % 2 = 0 then 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) else regexp_replace(url, '/+$', '') end || '/sitemap.xml' as url from (select page_id, url || case when page_id % 3 = 0 then '//' else '' end as url from pages)")
def c17(spark, d):
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "//").otherwise(""))
    return D.table(spark, d, "pages").select("page_id", U.sitemap_url(F.when(F.col("page_id") % 2 == 1, url), F.regexp_extract(url, "^https?://([^/]+)", 1)).alias("url"))


_ANSWER = "case doc_id % 3 when 0 then concat('```json', chr(10), text, chr(10), '```') when 1 then concat(' ```', text, '``` ') else text end"


@query("c18_fences", rf"with a as (select doc_id, {_ANSWER} as raw from documents where text is not null), t as (select doc_id, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') as t from a) select doc_id, case when regexp_matches(t, '(?s)^```(?:json)?\s*(.*?)\n?```$') then regexp_extract(t, '(?s)^```(?:json)?\s*(.*?)\n?```$', 1) else raw end as body from t")
def c18(spark, d):
    rows = D.table(spark, d, "documents").where("text is not null").selectExpr("doc_id", f"{_ANSWER} as raw")
    return rows.select("doc_id", T.without_fences(F.col("raw")).alias("body"))


@query("c22_mime", f"{_IMG}, m as (select page_id, pos, case when url like '%png%' then 'image/png' when url like '%webp%' then 'image/webp' else 'image/jpeg' end as mime from i) select page_id, pos, mime, case mime when 'image/png' then 'png' when 'image/webp' then 'webp' else 'jpg' end as extension from m")
def c22(spark, d):
    mime = T.mime_type(F.upper("url"))
    return img(spark, d).select("page_id", "pos", mime.alias("mime"), T.extension_of(mime).alias("extension"))


@query("c25_utf16_length", "select doc_id, cast(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as bigint) as units from documents where text is not null")
def c25(spark, d):
    return D.table(spark, d, "documents").where("text is not null").select("doc_id", T.utf16_length(F.col("text")).alias("units"))


@query("c33_progress", "with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as done, count(*) over (partition by user_id) as total from events) select event_id, floor(done / total * 1000.0 + 0.5) / 10 as percentage, cast(floor(event_id * 1.0 / done * (total - done) / 1000 + 0.5) as bigint) as eta from e")
def c33(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = D.table(spark, d, "events").select("event_id", F.row_number().over(own.orderBy("event_id")).alias("done"), F.count("*").over(own).alias("total"))
    return rows.select("event_id", N.percentage(F.col("done"), F.col("total")).cast("double").alias("percentage"), N.eta_seconds(F.col("event_id"), F.col("done"), F.col("total")).cast("long").alias("eta"))


@query("k03_progress_path", "select page_id, 's' || page_id || '.progress.json' as path from pages")
def k03(spark, d):
    snap = F.concat(F.lit("s"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".json").otherwise(""))
    return D.table(spark, d, "pages").select("page_id", U.progress_path(snap).alias("path"))


# --- JSON and recognised lines -------------------------------------------------------------------------

_PAY = f"with p as ({D.PAYLOADS})"


_ITEM = """j as (select doc_id, case when json_valid(payload) then payload end as j from p), v as (select doc_id, j, case when json_type(j, '$.response.prod.description') = 'VARCHAR' then nullif(j ->> '$.response.prod.description', '') end as description, case when json_type(j, '$.response.prod.name') = 'VARCHAR' then nullif(j ->> '$.response.prod.name', '') end as name, coalesce(case when json_type(j, '$.response.prod.photos') = 'ARRAY' then json_array_length(j, '$.response.prod.photos') end, 0) as photos, coalesce(case when json_type(j, '$.response.prod.q_and_a') = 'ARRAY' then json_array_length(j, '$.response.prod.q_and_a') end, 0) as answers from j where json_type(j, '$.response.prod') = 'OBJECT')"""
_USEFUL = "description is not null or photos > 0 or answers > 0"



@query("c40_item_query", f"{_PAY}, {_ITEM} select doc_id, description, name, cast(photos as bigint) as photos from v where {_USEFUL}")
def c40(spark, d):
    art = derived(spark, d, D.PAYLOADS).withColumn("j", J.item_query_artifact(F.lit("https://q.test/1"), F.col("payload"))).where("j is not null").withColumn("v", F.parse_json("j"))
    return art.select("doc_id", F.try_variant_get("v", "$.prod.description", "string").alias("description"), F.try_variant_get("v", "$.prod.name", "string").alias("name"), F.size(J.array_at(F.col("v"), "$.prod.photos")).cast("long").alias("photos"))


@query("f14_usable_script", f"{_PAY}, {_ITEM}, w as (select doc_id from v where {_USEFUL}) select p.doc_id, w.doc_id is not null as usable from p left join w on w.doc_id = p.doc_id")
def f14(spark, d):
    art = derived(spark, d, D.PAYLOADS).withColumn("j", J.item_query_artifact(F.lit("https://q.test/</SCRIPT>"), F.col("payload")))
    html = F.when(F.col("j").isNull(), F.lit("<p>x</p>")).otherwise(J.append_script(F.lit("<p>x</p>"), F.col("j")))
    return art.select("doc_id", J.has_usable_script(html).alias("usable"))


@query("k04_append_script", "select page_id, html || chr(10) || '<script type=\"application/json\" data-scraper-bvshop-item-query>' || regexp_replace(j, '(?i)</script', '<\\\\/script', 'g') || '</script>' || chr(10) as html from (select page_id, html, '{\"a\":\"</Script>' || url || '</SCRIPT\"}' as j from pages)")
def k04(spark, d):
    json = F.concat(F.lit('{"a":"</Script>'), F.col("url"), F.lit('</SCRIPT"}'))
    return D.table(spark, d, "pages").select("page_id", J.append_script(F.col("html"), json).alias("html"))


@query("c42_layout", "select doc_id, case when doc_id % 4 in (0, 1) then 2 end::integer as n_lines, case when doc_id % 4 in (0, 1) then 1 end::integer as n_boxes from documents")
def c42(spark, d):
    lines = '[{"text":"a","confidence":0.5,"boundingBox":{"x":0.1,"y":0.1,"width":0.2,"height":0.2}},{"text":"b","confidence":1,"boundingBox":{"x":0.9,"y":0,"width":0.2,"height":0.1}},{"text":3,"confidence":0.5},{"text":"c","confidence":1.5}]'
    n = F.col("doc_id") % 4
    text = F.when(n == 0, f'{{"provider":"p","coordinateSystem":"normalized-lower-left","lines":{lines}}}').when(n == 1, f'{{"provider":"p","coordinateSystem":"normalized-upper-left","lines":{lines}}}').when(n == 2, f'{{"provider":"p","coordinateSystem":"pixels","lines":{lines}}}').otherwise("{bad")
    rows = D.table(spark, d, "documents").withColumn("l", J.layout(text))
    return rows.select("doc_id", F.when(F.col("l").isNotNull(), F.size("l.lines")).alias("n_lines"), F.when(F.col("l").isNotNull(), F.size(F.filter("l.lines", lambda x: x["bounding_box"].isNotNull()))).alias("n_boxes"))


@query("c43_ocr_parse", "select doc_id, case doc_id % 3 when 0 then 'a' || chr(10) || 'b' else '' end as markdown, case doc_id % 3 when 0 then 'HIGH' else 'LOW' end as band, case doc_id % 3 when 1 then 'PROVIDER_ERROR' when 2 then 'NO_TEXT' end as reason, case doc_id % 3 when 1 then 'NO_IMAGE: cannot decode' when 2 then 'no text lines returned' end as notes from documents")
def c43(spark, d):
    n = F.col("doc_id") % 3
    out = F.when(n == 0, '{"ok":true,"lines":[{"text":" a ","confidence":0.9},{"text":" ","confidence":0.1},{"text":"b","confidence":0.8}]}').when(n == 1, '{"ok":false,"error":{"code":"NO_IMAGE","message":"cannot decode"}}').otherwise('{"ok":true,"lines":[{"text":"  ","confidence":0.9}]}')
    rows = D.table(spark, d, "documents").withColumn("r", J.recognised(out))
    return rows.select("doc_id", F.col("r.raw_markdown").alias("markdown"), F.col("r.confidence").alias("band"), F.col("r.fallback_reason").alias("reason"), "r.notes")


_OCR = f"with o as ({D.OCR_DUCK})"


def ocr_lines(spark, d):
    return derived(spark, d, D.OCR_SPARK)


@query("a06_avg_confidence", f"{_OCR} select doc_id, cast(printf('%.3f', avg(confidence)) as double) as average, case when cast(printf('%.3f', avg(confidence)) as double) >= 0.82 then 'HIGH' when cast(printf('%.3f', avg(confidence)) as double) >= 0.55 then 'MEDIUM' else 'LOW' end as band from o group by 1")
def a06(spark, d):
    return ocr.confidence(ocr_lines(spark, d))


@query("a09_markdown", f"{_OCR} select doc_id, coalesce(string_agg(trim(text, chr(32) || chr(9) || chr(13)), chr(10) order by pos) filter (trim(text, chr(32) || chr(9) || chr(13)) <> ''), '') as markdown from o group by 1")
def a09(spark, d):
    return ocr.markdown(ocr_lines(spark, d))


@query("c21_quality", "with t as (select doc_id, [text, case doc_id % 3 when 0 then '黄者 萃取物' when 1 then '黃蓍' else '黃耆' end || substr(text, 2), case when doc_id % 3 = 1 then 'x黄者' else 'y' end] as t from documents where text is not null) select doc_id, array_to_string(list_filter([case when contains(array_to_string(t, chr(10)), '黄者') then 'suspect_黃耆_as_黄者' end, case when contains(array_to_string(t, chr(10)), '黃蓍') then 'suspect_黃耆_as_黃蓍' end], lambda x: x is not null), ';') as warnings from t")
def c21(spark, d):
    n, text = F.col("doc_id") % 3, F.col("text")
    texts = F.array(text, F.concat(F.when(n == 0, "黄者 萃取物").when(n == 1, "黃蓍").otherwise("黃耆"), F.substr(text, F.lit(2))), F.when(n == 1, "x黄者").otherwise("y"))
    return D.table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(ocr.run_checks(texts, [ocr.confusion_check]), ";").alias("warnings"))


@query("c30_band", f"{_OCR} select doc_id, pos, case when pos % 11 = 0 then 'LOW' when confidence >= 0.82 then 'HIGH' when confidence >= 0.55 then 'MEDIUM' else 'LOW' end as band from o")
def c30(spark, d):
    return ocr_lines(spark, d).select("doc_id", "pos", N.confidence_band(F.when(F.col("pos") % 11 != 0, F.col("confidence"))).alias("band"))


# --- artifacts ------------------------------------------------------------------------------------------

_ART = f"with a as ({D.ARTIFACTS}), h as ({D.HEADS})"
_ROLES = "coalesce(roles_csv, case when artifact_kind = 'html' then 'html' else 'unknown' end)"
_LEN = "(length(raw_markdown) + length(regexp_replace(raw_markdown, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query("j01_full_context_join", f"{_ART} select page_id, id, {_ROLES} as roles from a")
def j01(spark, d):
    arts, cls = classified(spark, d)
    return A.full_context(arts, cls, VOCABULARY).select("page_id", "id", F.array_join("roles", ",").alias("roles"))


_OK = "(list_has_any(string_split(roles_csv, ','), ['html', 'datasheet']) and (list_contains(string_split(roles_csv, ','), 'html') or not list_has_any(string_split(roles_csv, ','), ['promo', 'ui', 'related-product'])))"


@query("f12_selectable", f"{_ART} select page_id, id, {_OK} as ok from a where roles_csv is not null")
def f12(spark, d):
    _, cls = classified(spark, d)
    return cls.select("page_id", "id", A.selectable(F.col("roles"), VOCABULARY.preferences["specs"], VOCABULARY).alias("ok"))


_COUNTS = ", ".join(f"count(*) filter (list_contains(string_split(roles, ','), '{r}')) as role_{r.replace('-', '_')}" for r in VOCABULARY.roles)


@query("a03_role_counts", f"{_ART}, r as (select page_id, {_ROLES} as roles from a) select page_id, {_COUNTS} from r group by 1")
def a03(spark, d):
    arts, cls = classified(spark, d)
    return A.role_counts(A.full_context(arts, cls, VOCABULARY), VOCABULARY, "page_id")


@query("a04_default_roles", f"{_ART}, r as (select page_id, case when artifact_kind = 'html' then 'html' else 'unknown' end as roles from a) select page_id, {_COUNTS} from r group by 1")
def a04(spark, d):
    arts, _ = classified(spark, d)
    return A.role_counts(A.default_classification(arts, VOCABULARY)[1], VOCABULARY, "page_id")


@query("x07_unknown_roles", f"{_ART}, r as (select page_id, id, unnest(string_split(roles_csv, ',')) as role from a where roles_csv is not null) select page_id, role, count(*) as n from r where role not in ('html', 'promo', 'unknown') group by 1, 2")
def x07(spark, d):
    _, cls = classified(spark, d)
    return A.unknown_roles(cls, A.Vocabulary(roles=("html", "promo", "unknown")), "page_id")


@query("a05_chars", f"{_ART} select page_id, cast(sum({_LEN}) as bigint) as chars from a group by 1")
def a05(spark, d):
    return A.characters(classified(spark, d)[0], "page_id")


_P01 = f"""{_ART}, s as (select a.page_id, count(*) as n_in, sum({_LEN}) as before, count(*) filter (roles_csv is not null and {_OK}) as n_ok, coalesce(sum({_LEN}) filter (roles_csv is not null and {_OK}), 0) as ok_chars, coalesce(bool_or(roles_csv is not null and list_has_any(string_split(roles_csv, ','), ['product-description','certificate','related-product','promo','ui','datasheet'])), false) as informs from a group by 1),
 o as (select s.*, coalesce(h.provider_name, 'default') as provider_name, h.provider_reason, case when h.provider_name is null then 'none' when h.selection_mode <> 'full' and not informs then 'empty' when h.selection_mode = 'full' then 'full' when n_ok = 0 then 'unselected' else 'chosen' end as outcome from s left join h on h.page_id = s.page_id)"""
_REASON = "case outcome when 'none' then 'NO_PROVIDER' when 'empty' then 'CLASSIFICATION_EMPTY' when 'unselected' then 'NO_SELECTED_ARTIFACTS' else case when provider_reason is not null then 'PROVIDER_FALLBACK' end end"


@query("p01_projection_context", f"{_P01} select page_id, provider_name, case outcome when 'chosen' then n_ok else n_in end as selected, case outcome when 'chosen' then n_in - n_ok else 0 end as dropped, cast(before as bigint) as chars_before, cast(case outcome when 'chosen' then ok_chars else before end as bigint) as chars_after, {_REASON} as fallback_reason, provider_reason from o")
def p01(spark, d):
    arts, cls = classified(spark, d)
    return A.project(arts, derived(spark, d, D.HEADS), cls, "specs", VOCABULARY)[0]


@query("p01_selected_artifacts", f"{_P01} select a.page_id, a.id, case o.outcome when 'chosen' then roles_csv when 'none' then case when artifact_kind = 'html' then 'html' else 'unknown' end else {_ROLES} end as roles from a join o on o.page_id = a.page_id where o.outcome <> 'chosen' or (roles_csv is not null and {_OK})")
def p01_detail(spark, d):
    arts, cls = classified(spark, d)
    return A.project(arts, derived(spark, d, D.HEADS), cls, "specs", VOCABULARY)[1].select("page_id", "id", F.array_join("roles", ",").alias("roles"))


@query("j02_role_semi", f"{_P01}, t as (select a.page_id, a.id, case o.outcome when 'chosen' then roles_csv when 'none' then case when artifact_kind = 'html' then 'html' else 'unknown' end else {_ROLES} end as roles, {_REASON} as why from a join o on o.page_id = a.page_id where o.outcome <> 'chosen' or (roles_csv is not null and {_OK})), m as (select *, list_contains(string_split(roles, ','), 'certificate') as hit, bool_or(list_contains(string_split(roles, ','), 'certificate')) over (partition by page_id) as any_hit from t) select page_id, id from m where hit or (not any_hit and why is not null)")
def j02(spark, d):
    arts, cls = classified(spark, d)
    summary, detail = A.project(arts, derived(spark, d, D.HEADS), cls, "specs", VOCABULARY)
    return A.with_roles(detail, summary, ["certificate"]).select("page_id", "id")


@query("a11_reconcile_summary", "with g as (select user_id, event_type, count(*) as n from events group by 1, 2) select count(*) as canonical_records, cast(sum(n - 1) as bigint) as merged_away_records, count(*) filter (n > 1) as duplicate_groups from g")
def a11(spark, d):
    from storeloom.operators.stages import reconcile_summary

    return reconcile_summary(D.table(spark, d, "events"), "user_id", "event_type")


# --- pacing and model calls ---------------------------------------------------------------------------------


@query("t01_pacing", f"with r as (select *, row_number() over (partition by host_id order by seq) as n from ({D.REQUESTS_DUCK})) select host_id, seq, t_us, max(t_us - n * 2000000) over (partition by host_id order by seq rows unbounded preceding) + n * 2000000 as slot, max(t_us - n * 2000000) over (partition by host_id order by seq rows unbounded preceding) + n * 2000000 - t_us as wait from r")
def t01(spark, d):
    return pacing.schedule(derived(spark, d, D.REQUESTS_SPARK), 2_000_000)


_STATUS = "case when event_id % 9 = 0 then null when event_id % 9 = 1 then 401 when event_id % 9 = 2 then 404 when event_id % 9 = 3 then 429 when event_id % 9 = 4 then 503 when event_id % 9 = 5 then 403 when event_id % 9 = 6 then 400 else 500 end"


@query("p06_error_codes", f"with s as (select event_id, {_STATUS} as status from events) select event_id, case when status is null then 'NETWORK' when status in (401, 403) then 'AUTH' when status = 404 then 'MODEL_NOT_FOUND' when status = 429 then 'RATE_LIMITED' when status between 500 and 599 then 'PROVIDER_ERROR' else 'UNKNOWN' end as code from s")
def p06(spark, d):
    rows = D.table(spark, d, "events").selectExpr("event_id", f"{_STATUS} as status")
    return rows.select("event_id", model_client.code_of_status(F.col("status")).alias("code"))


@query("a07_usage", "select user_id, cast(sum(event_id % 100) as bigint) as total_tokens, max_by(event_id % 100, event_id) as last_tokens from events group by 1")
def a07(spark, d):
    from storeloom.operators.stages import usage_totals

    rows = D.table(spark, d, "events").selectExpr("user_id", "event_id as attempt", "event_id % 100 as total_tokens")
    return usage_totals(rows, "user_id")


# --- catalogue and scaffold ----------------------------------------------------------------------------------


# a catalogue of pages: the language is the axis, the path's end the symbol
_CAT = "select regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) as symbol, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as axis, url as summary from pages"


@query("f15_catalogue_search", f"with c as ({_CAT}) select symbol, axis, summary from c where contains(lower(symbol), '1') or contains(lower(summary), '1') or contains(lower(summary), 'utm') or contains(lower(symbol), 'utm')")
def f15(spark, d):
    from storeloom.operators import catalogue

    # in the SQL's patterns a dot is anything but a line feed, in Spark's no other line end either
    known = D.table(spark, d, "pages").select(F.regexp_extract("url", r"([^/?#]*)([?#][^\n]*)?\z", 1).alias("symbol"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("axis"), F.col("url").alias("summary"))
    return catalogue.search(known, "UTM", "1")


@query("x05_axis_and_search", f"with c as ({_CAT}) select symbol, axis, summary from c where axis = 'es' and symbol in (select symbol from c where contains(lower(symbol), '1') or contains(lower(summary), '1'))")
def x05(spark, d):
    from storeloom.operators import catalogue

    known = D.table(spark, d, "pages").select(F.regexp_extract("url", r"([^/?#]*)([?#].*)?\z", 1).alias("symbol"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("axis"), F.col("url").alias("summary"))
    return catalogue.matching(known, "es", "1")


@query("j10_parity", f"with c as ({_CAT}), s as (select distinct symbol from c where axis in ('es', 'fr')), e as (select distinct symbol from c where axis in ('fr', 'de')) select symbol, 'catalogue' as missing from (select symbol from e except all select symbol from s) union all select symbol, 'exports' from (select symbol from s except all select symbol from e)")
def j10(spark, d):
    from storeloom.operators import catalogue

    known = D.table(spark, d, "pages").select(F.regexp_extract("url", r"([^/?#]*)([?#].*)?\z", 1).alias("symbol"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("axis"))
    return catalogue.parity(known.where("axis in ('es', 'fr')"), known.where("axis in ('fr', 'de')"))


_SPEC = "select page_id, case when page_id % 7 = 0 then url else 'shop' || page_id end as name, case when page_id % 5 = 0 then url else regexp_extract(url, '^https?://([^/]+)', 1) end as raw_host, case when page_id % 11 = 0 then substr(url, 2) else url end as site_url, case page_id % 3 when 0 then 'bvshop' when 1 then 'custom' else 'shopline' end as platform, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as segment, case when page_id % 2 = 0 then cast(page_id as string) end as store_id, case when page_id % 4 = 0 then regexp_extract(url, '^https?://([^?]+)', 1) when page_id % 4 = 1 then 'cdn.test' end as cdn from pages"
_LABEL_HOST = "^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$"


@query("f17_scaffold_problems", f"with s as ({_SPEC}) select page_id, case when not regexp_matches(name, '^[a-z][a-z0-9-]*$') then 'name' when not regexp_matches(raw_host, '{_LABEL_HOST}') then 'rawHost' when not regexp_matches(site_url, '^https?://') then 'siteUrl' when not regexp_matches(segment, '^[A-Za-z0-9][A-Za-z0-9/-]*$') then 'productPathSegment' when platform = 'bvshop' and coalesce(store_id, '') = '' then 'storeId' when platform = 'custom' and coalesce(cdn, '') = '' then 'imageCdnHost' when cdn is not null and not regexp_matches(cdn, '{_LABEL_HOST}') then 'imageCdnHostShape' end as problem from s")
def f17(spark, d):
    from storeloom.operators import scaffold

    rows = derived(spark, d, _SPEC)
    return rows.select("page_id", scaffold.problem(*(F.col(c) for c in ("name", "raw_host", "site_url", "platform", "segment", "store_id", "cdn"))).alias("problem"))


@query("a12_usefulness", "select count(*) as total, count(*) filter (event_type = 'view') as useful, count(*) filter (event_type = 'view') as role_view, count(*) filter (event_type = 'click') as role_click from events")
def a12(spark, d):
    from storeloom.operators.stages import usefulness

    rows = D.table(spark, d, "events").select((F.col("event_type") == "view").alias("useful"), F.col("event_type").alias("role"))
    return usefulness(rows, ("view", "click"))


@query("a11_gate_summary", f"{_SEEN} select count(*) as total_pages, count(*) filter (product and segment is not null) as parsed_products, count(*) filter (not product) as noJsonLdBlock, count(*) filter (product and segment is null) as missingProductId from o")
def a11_gates(spark, d):
    from storeloom.operators.stages import gate_summary

    obs = observe.observe(pages(spark, d))
    return gate_summary(obs, {"noJsonLdBlock": ~F.col("has_product_data"), "missingProductId": F.col("product_path_segment").isNull()})


@query("c19_product_url", "select page_id, 'https://s.test/item/' || replace(replace(replace(replace(replace(url_encode('a b+é~!*''()' || url), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')') as url from pages")
def c19(spark, d):
    slug = F.concat(F.lit("a b+é~!*'()"), F.col("url"))
    return D.table(spark, d, "pages").select("page_id", U.product_url(F.lit("https://s.test/"), slug, "/item/").alias("url"))


@query("u04_per_artifact", f"{_ART} select page_id, id, case when artifact_kind = 'html' then 'html' when id % 3 = 0 then 'datasheet' else 'promo' end as roles from a")
def u04(spark, d):
    arts, _ = classified(spark, d)
    rule = F.array(F.when(F.col("artifact_kind") == "html", "html").when(F.col("id") % 3 == 0, "datasheet").otherwise("promo"))
    return A.per_artifact(arts, "rule", rule)[1].select("page_id", "id", F.array_join("roles", ",").alias("roles"))


@query("u05_default_provider", f"{_ART} select page_id, id, case when artifact_kind = 'html' then 'html' else 'unknown' end as roles from a")
def u05(spark, d):
    arts, _ = classified(spark, d)
    return A.default_classification(arts, VOCABULARY)[1].select("page_id", "id", F.array_join("roles", ",").alias("roles"))


@query("f13_informative", f"{_ART}, c as (select page_id, bool_or(list_has_any(string_split(roles_csv, ','), ['product-description','certificate','related-product','promo','ui','datasheet'])) as informs from a where roles_csv is not null group by 1) select page_id, informs from c")
def f13(spark, d):
    _, cls = classified(spark, d)
    return cls.groupBy("page_id").agg(F.max(A.informative(F.col("roles"), VOCABULARY)).alias("informs"))


@query("f18_keep_all", f"{_IMG} select page_id, count(*) as total, count(*) as selected, cast(0 as bigint) as dropped from i group by 1")
def f18(spark, d):
    return images.stats(images.keep_all(img(spark, d)), ()).select("page_id", "total", "selected", "dropped")


@query("c02_unescape", r"select page_id, replace(replace(replace(url, '/', '\/') || '&amp;x', '&amp;', '&'), '\/', '/') as url from pages")
def c02(spark, d):
    raw = F.concat(F.replace(F.col("url"), F.lit("/"), F.lit("\\/")), F.lit("&amp;x"))
    return D.table(spark, d, "pages").select("page_id", T.unescape_markup(raw).alias("url"))


@query("c44_empty_result", "select page_id, '' as markdown, 'LOW' as band, 'a; b' as notes, 'NO_TEXT' as reason from pages")
def c44(spark, d):
    r = ocr.empty_result("p", "NO_TEXT", ["a", "b"])
    return D.table(spark, d, "pages").select("page_id", r.alias("r")).select("page_id", F.col("r.raw_markdown").alias("markdown"), F.col("r.confidence").alias("band"), "r.notes", F.col("r.fallback_reason").alias("reason"))


# --- fetching and asking, by transports and clients that answer from the URL or prompt itself ---------------


def _transport(url, headers, timeout):
    n = len(url) % 7
    if n == 1:
        raise TimeoutError
    if n == 2:
        raise OSError("no route")
    kinds = {3: {"content-type": "image/PNG; q=1"}, 4: {"Content-Type": "image/webp"}, 5: {}}
    return (404 if n == 6 else 200), kinds.get(n, {"Content-Type": "text/html"}), f"<p>{url}</p>".encode()


_FETCHED = "f as (select url, length(url) % 7 as n from (select distinct url from pages))"


@query("s10_fetch_text", f"with {_FETCHED} select url, case when n in (1, 2) then null when n = 6 then 404 else 200 end::integer as status, case n when 1 then null when 2 then null when 3 then 'image/PNG; q=1' when 4 then 'image/webp' when 5 then null else 'text/html' end as content_type, case when n in (1, 2, 6) then null else '<p>' || url || '</p>' end as text, case n when 1 then 'FETCH_ABORTED' when 2 then 'FETCH_FAILED' when 6 then 'HTTP_STATUS' end as error_code from f")
def s10(spark, d):
    from storeloom.sources import http

    return http.fetch_text(D.table(spark, d, "pages").select("url").distinct(), _transport, interval_ms=0)


@query("s12_fetch_images", f"with {_FETCHED} select url, case when n in (1, 2, 6) then null else to_base64(encode('<p>' || url || '</p>')) end as base64, case when n in (1, 2, 6) then null when n = 3 then 'image/png' when n = 4 then 'image/webp' else 'image/jpeg' end as mime_type, case when n in (1, 2) then null when n = 6 then 404 else 200 end::integer as status, case when n in (1, 2) then 'FETCH_FAILED' when n = 6 then 'HTTP_NOT_OK' end as error_code from f")
def s12(spark, d):
    from storeloom.sources import http

    rows = http.fetch_images(D.table(spark, d, "pages").select("url").distinct(), _transport, interval_ms=0)
    # the encoder breaks long output into lines
    return rows.withColumn("base64", F.regexp_replace("base64", r"[\r\n]", ""))


_ANSWERS = {"type": "object", "required": ["url", "n"], "properties": {"url": {"type": "string"}, "n": {"type": "integer", "minimum": 0}}}


def _client():
    """Answers by the prompt's length, and by how often it was asked since its last good answer: pages may share a prompt."""
    import json

    asked: dict[str, int] = {}

    def ask(model, messages, timeout):
        prompt = messages[0]["content"]
        good, usage, n = json.dumps({"url": prompt, "n": len(prompt)}), {"prompt_tokens": len(prompt), "completion_tokens": 2, "total_tokens": len(prompt) + 2}, len(prompt) % 6
        nth = asked.pop(prompt, 0) + 1
        if nth < {1: 2, 3: 3}.get(n, 1):
            asked[prompt] = nth
        if n == 1 and nth == 1:
            raise OSError("reset")
        if n == 2:
            raise model_client.ModelError("AUTH")
        if n == 5:
            raise model_client.ModelError("PROVIDER_ERROR")
        if n == 3 and nth < 3:
            return '{"url": 7}' if nth == 1 else "no json", usage
        return "" if n == 4 else f"```json\n{good}\n```", usage

    return ask


@query("p06_extract", "with q as (select page_id, url, length(url) as l, length(url) % 6 as n from pages), a as (select *, case n when 0 then 1 when 1 then 2 when 2 then 1 else 3 end as attempts, case n when 2 then 0 when 5 then 0 when 0 then 1 when 1 then 1 else 3 end as answered from q) select page_id as id, case when n in (0, 1, 3) then url end as url, case when n in (0, 1, 3) then l end as n, case n when 2 then 'AUTH' when 4 then 'EMPTY_RESPONSE' when 5 then 'PROVIDER_ERROR' end as error_code, attempts::integer as attempts, cast(l * answered as bigint) as prompt_tokens, cast((l + 2) * answered as bigint) as total_tokens from a")
def p06_extract(spark, d):
    rows = D.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("prompt"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("mime"))
    out = model_client.complete(rows, _client, "t", "v", _ANSWERS)
    return out.select("id", F.get_json_object("content", "$.url").alias("url"), F.get_json_object("content", "$.n").cast("long").alias("n"), "error_code", "attempts", "prompt_tokens", "total_tokens")


def _engine():
    import json

    def read(content, mime):
        text = content.decode()
        if mime != "image/png":
            raise ValueError("cannot decode")
        return json.dumps({"ok": True, "lines": [{"text": x, "confidence": 0.9} for x in text.split("\n")]})

    return read


@query("u06_transcribe", r"select doc_id as id, case when doc_id % 3 = 0 then '' else coalesce((select string_agg(trim(x, chr(32) || chr(9) || chr(13)), chr(10) order by i) from (select unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i) where trim(x, chr(32) || chr(9) || chr(13)) <> ''), '') end as markdown, case when doc_id % 3 = 0 then 'PROVIDER_ERROR' when regexp_matches(text, '\S') then null else 'NO_TEXT' end as reason, case when doc_id % 3 = 0 then 'ValueError: cannot decode' when regexp_matches(text, '\S') then null else 'no text lines returned' end as notes from documents where text is not null")
def u06(spark, d):
    from storeloom.sources import recogniser

    rows = D.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 3 == 0, "text/html").otherwise("image/png").alias("mime_type"))
    return recogniser.transcribe(rows, _engine).select("id", F.col("result.raw_markdown").alias("markdown"), F.col("result.fallback_reason").alias("reason"), "result.notes")


@query("s04_candidates_with_meta", f"{_CAND} select pos, product_url as url, product_id, product_url || '#' || pos as meta from c where coalesce(product_url,'')<>'' and coalesce(product_id,'')<>''")
def s04(spark, d):
    rows = derived(spark, d, D.CANDIDATES).withColumn("meta", F.concat("product_url", F.lit("#"), F.col("pos").cast("string")))
    return discovery.load_candidates(rows.where(discovery.missing_field(F.col("product_url"), F.col("product_id")).isNull()), meta=True)


@query("c06_plain_pattern", "select page_id, contains(url, '.example.org/es/1') as found, contains(url, '?utm_source=feed') as tagged from pages")
def c06(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.col("url").rlike(T.plain(".example.org/es/1")).alias("found"), F.col("url").rlike(T.plain("?utm_source=feed")).alias("tagged"))


@query("t03_snapshot", "select cast(page_id as varchar) as product_id, html from pages where page_id % 3 <> 0")
def t03(spark, d):
    from storeloom.functions.lineage import new_folder
    from storeloom.streaming import snapshots

    path = new_folder(spark, "snapshots")
    pages_ = D.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("product_id"), "html", F.lit("h.test").alias("host"), F.when(F.col("page_id") % 3 == 0, "2026-Q2").otherwise("2026-Q3").alias("quarter"))
    snapshots.write_snapshot(pages_, path)
    return snapshots.read_snapshot(spark, path, "h.test", "2026-Q3").select("product_id", "html")


@query("t04_phases", "select regexp_replace(url, '[?#].*$', '') as url, count(*) as n from pages where html is not null group by 1")
def t04(spark, d):
    from storeloom.functions.lineage import new_folder
    from storeloom.plans.phases import run_phases

    steps = {
        "reconcile": lambda rows: rows.groupBy("url").agg(F.count("*").alias("n")),
        "download": lambda rows: rows.where("html is not null").select("url"),
        "stage": lambda rows: rows.withColumn("url", F.regexp_replace("url", r"[?#].*\z", "")),
    }
    return run_phases(spark, D.table(spark, d, "pages"), steps, new_folder(spark, "phases"))


@query("u11_source_hooks", f"{_SEEN} select page_id, case when product then url else 'no product' end as fact, case when segment is null then 'none' else segment end as path from o where kind = 'shopline'")
def u11(spark, d):
    from storeloom.operators import platforms, stages

    source = platforms.define_shopline_source(
        "s", "shop.example.test", "/products/(.+)",
        structured_facts=lambda rows: rows.select("page_id", F.when(F.col("has_product_data"), F.col("url")).otherwise("no product").alias("fact")),
        download=platforms.Download("https://shop.example.test"),
        stage=lambda rows: rows.withColumn("path", F.coalesce("product_path_segment", F.lit("none"))),
        reconcile=lambda rows: rows.dropDuplicates(["page_id"]),
    )
    return stages.run_source(source, observe.observe(pages(spark, d)).where(F.col("platform.kind") == "shopline")).select("page_id", "fact", "path")
