"""Inputs of the storefront queries, derived from the tables alike in Spark and DuckDB.

Each recipe is SQL that both engines read the same, but for the two where a function differs by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES = """
select user_id as page_id, event_id as pos,
 case when event_type in ('view','click') then concat('https://shoplineimg.com/st/', substr(md5(cast(user_id*10 + event_id % 7 as string)),1,24), '/', case event_id % 5 when 0 then '48' when 1 then '100' when 2 then '200' when 3 then '400' else '800' end, 'x.jpg')
 when event_type='purchase' then concat('https://image.bvshop.tw/42/', case event_id % 4 when 0 then 'product' when 1 then 'ckeditor' when 2 then 'logo' else 'favicon' end, '/p', cast(event_id % 11 as string), '.jpg', case event_id % 3 when 0 then '' when 1 then '.webp' else '?v=1' end)
 when event_type='signup' then concat('https://cdn', case when event_id % 2 = 0 then '-ap-1' else '' end, '.cybassets.com/media/', cast(event_id % 9 as string), '.png')
 else concat('https://js.bvshop.tw/s_template/', cast(event_id % 5 as string), '.png') end as url from events"""

PATHS = "select page_id, 'h' as host, regexp_replace(url, '^https?://[^/]+', '') as path from pages"
RULES = (("disallow", "/en/1"), ("allow", "/en/12"), ("disallow", "/fr/"), ("unsupported", "/es/*.html$"), ("disallow", "/de/9*"))

SITEMAPS = """
select page_id, case when page_id % 10 = 0 then concat('<sitemapindex><sitemap><loc>https://s.test/sm/', cast(page_id+1 as string), '.xml</loc></sitemap></sitemapindex>')
 else concat('<urlset><url><loc> ', replace(url,'&','&amp;'), ' </loc></url><url><loc>https://shop.example.test/products/p%20', cast(page_id as string), '+x</loc></url></urlset>') end as xml from pages"""

# a root, an index for each 500 pages, and a sitemap for every page
TREE = """
select concat('https://s.test/i', cast(parent as string)) as url, concat('<sitemapindex>', {agg_p}, '</sitemapindex>') as xml
from (select cast((page_id - page_id % 500) / 500 as bigint) as parent, concat('<loc>https://s.test/p', cast(page_id as string), '</loc>') as child from pages) as e group by parent
union all
select 'https://s.test/0' as url, concat('<sitemapindex>', {agg_p}, '</sitemapindex>') as xml from (select distinct concat('<loc>https://s.test/i', cast(cast((page_id - page_id % 500) / 500 as bigint) as string), '</loc>') as child from pages) as f
union all
select concat('https://s.test/p', cast(page_id as string)) as url, concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url><url><loc>https://shop.example.test/products/', cast(page_id % 40 as string), '</loc></url></urlset>') as xml from pages"""
TREE_SPARK = TREE.replace("{agg_p}", "array_join(array_sort(collect_list(child)), '')")
TREE_DUCK = TREE.replace("{agg_p}", "string_agg(child, '' order by child)")

# a robots file for every page: its own path is forbidden, what its path begins with is allowed
ROBOTS = """
select page_id, concat('User-agent: a', chr(10), 'Disallow: /only-a', chr(10), 'User-agent: b', chr(13), chr(10), 'USER-AGENT : *', chr(10), chr(10), 'Sitemap: ', url, chr(10), 'Disallow: ', regexp_replace(url, '^https?://[^/]+', ''), ' # of page ', cast(page_id as string), chr(10),
 'no directive', chr(10), 'Allow:', regexp_replace(url, '^https?://[^/]+(/[^/]*).*$', '{group}'), chr(10), 'Disallow:', chr(10), 'Disallow: /', cast(page_id as string), '/*.html$', chr(10), 'Crawl-delay: 3', chr(10), 'User-agent: c', chr(10), 'Disallow: /') as text from pages"""
ROBOTS_SPARK, ROBOTS_DUCK = ROBOTS.replace("{group}", "$1"), ROBOTS.replace("{group}", "\\1")

ARTIFACTS = """
select d.doc_id % 20 as page_id, d.doc_id as pos, d.doc_id as id, case when d.doc_id % 10 = 0 then 'html' else 'image' end as artifact_kind, coalesce(d.text, '') as raw_markdown,
 case when d.doc_id % 20 % 5 = 0 then null when l.doc_id is null then null when d.doc_id % 20 % 5 = 2 then 'unknown' when l.toxic=1 and d.lang='fr' then 'html,promo' when l.toxic=1 then 'promo' when l.quality=1 then 'datasheet' else 'certificate' end as roles_csv
from documents d left join labels l on d.doc_id=l.doc_id"""
HEADS = """
select distinct doc_id % 20 as page_id, 'rules' as provider_name, case when doc_id % 20 % 5 = 1 then 'full' else 'role-filtered' end as selection_mode, case when doc_id % 20 % 5 = 3 then 'partial' end as provider_reason
from documents where doc_id % 20 % 5 <> 0"""

OCR_SPARK = "select doc_id, cast(pos as bigint) as pos, col as text, ((doc_id*31 + pos*17) % 1000) / cast(1000 as double) as confidence from (select doc_id, posexplode(split(text, '\\n')) from documents)"
OCR_DUCK = "select doc_id, (i-1) as pos, s as text, ((doc_id*31 + (i-1)*17) % 1000) / cast(1000 as double) as confidence from (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(1, len(string_split(text, chr(10)))+1)) as i from documents)"

PAYLOADS = """
select doc_id, case doc_id % 5 when 0 then '{bad' when 1 then concat('{"response":{"prod":{"id":', cast(doc_id as string), ',"name":"n","description":"d","photos":[],"q_and_a":[]},"style":null}}')
 when 2 then '{"response":{"prod":{"id":1,"name":"only name"}}}' when 3 then '{"response":{"prod":{"id":2,"description":7,"photos":["u"]}}}' else '{"response":{}}' end as payload from documents"""

CANDIDATES = "select page_id as pos, case when page_id % 17 = 0 then null when page_id % 19 = 0 then '' else url end as product_url, case when page_id % 23 = 0 then null else concat('p', cast(page_id as string)) end as product_id from pages"

REQUESTS_SPARK = "select user_id as host_id, event_id as seq, unix_micros(cast(ts as timestamp)) as t_us from events"
REQUESTS_DUCK = "select user_id as host_id, event_id as seq, epoch_us(ts) as t_us from events"

PAGES = """
select page_id, concat('https://shop.example.test/', case page_id % 3 when 0 then 'products/' when 1 then 'item/' else '' end, cast(page_id as string)) as url,
 concat(html, case when page_id % 4 = 0 then '<script type="application/ld+json">{"@type": "Product", "name": }</script>' when page_id % 4 = 1 then '<script type="application/ld+json">{"@type":"BreadcrumbList"}</script>' else '' end,
 case page_id % 5 when 0 then '<img src="https://shoplineimg.com/a/1x.jpg">' when 1 then '<img src="https://cdn-ap-1.cybassets.com/media/a.jpg" data-src="https://cdn.cybassets.com/media/b.jpg">' when 2 then '<img src="https://image.bvshop.tw/42/product/a.jpg">'
 when 3 then '<img data-src="https://a.test/p-nutrition-facts.jpg"><img src="https://b.test/x-12-a.jpg"><img src="https://b.test/x-3-specifications.png">' else '' end) as html from pages"""

CONTEXTS = """
select doc_id, concat('<div class="', case doc_id % 6 when 0 then 'use_main_st_bg mobile' when 1 then 'a element_img_icon' when 2 then 'person_img' when 3 then 'use_main_st_bg mobiles' when 4 then 'endorsers' else 'plain' end, '">', coalesce(text, ''), case when doc_id % 7 = 0 then '見證' else '' end, '</div>') as context from documents"""


# images of pages with markup about some of them, which says what they are for
MARKED = """
select page_id, url, concat('<div class="', case page_id % 5 when 0 then 'a person_img' when 1 then 'tp use_main_st_bg' when 2 then 'element_img_icons' else 'plain' end, '"><img src="https://cdn.cybassets.com/media/', cast(page_id as string), '.png?a=1&amp;b=2"></div>', html, html, html,
 '<i class="', case page_id % 3 when 0 then 'new_pd_bg' when 1 then 'endorsers' else 'x' end, '"><img data-src="https://cdn-ap.cybassets.com/s/files/', cast(page_id % 7 as string), '.jpg"></i><p>', url, '</p><img src="https://cdn-ap.cybassets.com/s/files/', cast(page_id % 7 as string), '.jpg">') as html from pages"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A recipe over the tables that it names; as in DuckDB, concat takes a null part as an empty one."""
    import re

    names = {n for n in ("events", "pages", "documents", "labels", "conversations") if re.search(rf"\b{n}\b", sql)}
    held = {n: table(spark, sf_dir, n) for n in names}
    escaped = re.sub(r"\bconcat\(", "concat_ws('', ", sql).replace("{", "{{").replace("}", "}}")
    for n in names:
        escaped = re.sub(rf"\b(from|join)\s+{n}\b(\s+(?!where|group|left|order|union)[a-z]\b)?", lambda m, n=n: f"{m[1]} {{{n}}}{m[2] or ''}", escaped)
    return spark.sql(escaped, **held)
