"""Image selection against literal folds over random pages, and its stated cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storeloom.functions import urls as U
from storeloom.operators import images

ID = ["a" * 24, "b" * 24, "A" * 24]


def random_pages(n, make):
    rng = random.Random(7)
    return [(page, pos, make(rng)) for page in range(n) for pos in range(rng.randint(0, 12))]


def sized_url(rng):
    return rng.choice([f"https://h.test/{rng.choice(ID)}/{rng.choice([48, 100, 100, 200, 400])}x.{rng.choice(['jpg', 'png'])}", f"https://x.test/{rng.randint(0, 3)}.jpg"])


def fold_by_id(urls):
    best, notes, order, at = {}, {}, [], {}
    for u in urls:
        m = re.search(r"/([a-f0-9]{20,})/(\d+)x\.(?:jpe?g|png|webp)", u, re.I)
        if not m:
            continue
        i, size = m[1], int(m[2])
        if i not in best:
            best[i] = (u, size)
        else:
            loser, (big, small) = (best[i][0], (size, best[i][1])) if size > best[i][1] else (u, (best[i][1], size))
            notes[loser] = f"Shopline image_id {i} : {small}px superseded by {big}px"
            order.append(loser)
            if size > best[i][1]:
                best[i] = (u, size)
    return notes, order


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id int, pos int, url string")


def test_largest_by_id_equals_fold(spark):
    rows = random_pages(60, sized_url)
    unique = list({(p, u): (p, i, u) for p, i, u in reversed(rows)}.values())
    got = images.largest_by_id(frame(spark, unique)).collect()
    for page in {r[0] for r in unique}:
        urls = [u for p, i, u in sorted(unique, key=lambda r: r[1]) if p == page]
        notes, order = fold_by_id(urls)
        mine = [r for r in got if r.page_id == page]
        assert {r.url: r.note for r in mine if not r.kept} == notes
        assert [r.url for r in sorted((r for r in mine if not r.kept), key=lambda r: r.drop_order)] == order


def alias_url(rng):
    return f"https://image.bvshop.tw/42/product/p{rng.randint(0, 2)}.jpg{rng.choice(['', '.webp', '?v=1', '.webp?v=2', '#a'])}"


def test_alias_dedupe_equals_fold(spark):
    rows = random_pages(60, alias_url)
    unique = list({(p, u): (p, i, u) for p, i, u in reversed(rows)}.values())
    got = images.one_per_alias(frame(spark, unique)).collect()
    for page in {r[0] for r in unique}:
        groups = {}
        for u in [u for p, i, u in sorted(unique, key=lambda r: r[1]) if p == page]:
            key = re.sub(r"[?#].*$", "", re.sub(r"\.(jpe?g|png)\.webp(?=$|[?#])", r".\1", u))
            groups.setdefault(key, []).append(u)
        rank = lambda u: 2 * bool(re.search(r"\.jpg\.webp(?=$|[?#])", u)) + bool(re.search("[?#]", u))
        want = [min(us, key=rank) for us in groups.values()]
        mine = sorted((r for r in got if r.page_id == page and r.kept), key=lambda r: r.pos)
        assert [r.url for r in mine] == want


def test_cap(spark):
    rows = frame(spark, [(1, i, f"u{i}") for i in range(5)])
    kept = images.cap(images.keep_all(rows), 2)
    assert [r.url for r in kept.where("kept").orderBy("pos").collect()] == ["u0", "u1"]
    assert {r.note for r in kept.where("not kept").collect()} == {"selected image cap 2"}
    assert images.cap(images.keep_all(rows), 9).where("kept").count() == 5
    for bad in (0, -1, 1.5):
        with pytest.raises(images.SelectionError):
            images.cap(images.keep_all(rows), bad)


def test_audit(spark):
    rows = frame(spark, [(1, 0, "a"), (1, 1, "a"), (1, 2, "b")])
    assert images.validate(rows, images.keep_all(rows)).count() == 3
    lost = images.keep_all(rows).where("pos <> 1")
    assert [(r.url, r.unaccounted, r.outside) for r in images.audit(rows, lost).collect()] == [("a", 1, 0)]
    more = images.keep_all(frame(spark, [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")]))
    with pytest.raises(images.SelectionError, match="outside"):
        images.validate(rows, more)
    with pytest.raises(images.SelectionError, match="unaccounted"):
        images.validate(rows, lost)


@pytest.mark.parametrize(
    ("context", "reason"),
    [
        ('<div class="plain">', None),
        ('<div class="x person_img">', "brand_story_asset"),
        ('<i class="element_img_icon">', "decorative_asset"),
        ('<b class="mo use_main_st_bg">', "duplicate"),
        ('<b class="use_main_st_bg">', None),
        ('<b class="mobile2 use_main_st_bg">', None),
        ("代言mo言", "brand_story_asset"),
        ('<video muted poster="a">', "decorative_asset"),
        ("a product_pop_in_top", "decorative_asset"),
    ],
)
def test_contexts(spark, context, reason):
    got = spark.createDataFrame([(context,)], "c string").select(images.context_decision(F.col("c"))["reason"]).first()[0]
    assert got == reason


def test_windows_equal_a_scan(spark):
    rng = random.Random(3)
    url = "https://a.b/c?x&y"
    forms = [url, url[6:], url.replace("/", "\\/"), url[6:].replace("/", "\\/"), url.replace("&", "&amp;"), url[6:].replace("&", "&amp;")]
    html = "".join(rng.choice([*forms, "z" * rng.randint(1, 9), "é"]) for _ in range(40))
    want = []
    for form in dict.fromkeys(forms):
        at = html.find(form)
        while at >= 0:
            want.append(html[max(0, at - 7) : at + len(form) + 7])
            at = html.find(form, at + len(form))
    got = spark.createDataFrame([(html, url)], "h string, u string").select(images.context_windows(F.col("h"), F.col("u"), 7)).first()[0]
    assert got == want


def test_cyberbiz(spark):
    html = '<div class="person_img"><img src="https://c/1.jpg"></div>' + " " * 600 + '<img src="https://c/2.jpg">'
    rows = spark.createDataFrame([(1, i, f"https://c/{n}.jpg", html) for i, n in enumerate([1, 2, 2])], "page_id int, pos int, url string, html string")
    got = [(r.kept, r.reason) for r in images.cyberbiz(rows).orderBy("pos").collect()]
    assert got == [(False, "brand_story_asset"), (True, None), (False, "duplicate")]


def test_hosts(spark):
    cases = {"https://User@Shop.Test:443/a": "shop.test", "http://a.test:8080/": "a.test:8080", "http://a.test:80": "a.test", "nope": None}
    for url, host in cases.items():
        assert spark.createDataFrame([(url,)], "u string").select(U.host(F.col("u"))).first()[0] == host
