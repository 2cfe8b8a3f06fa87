"""A source's module from a few answers: checks of the answers, the module's text, the command lines."""

from __future__ import annotations

import argparse
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from storeloom.operators.observe import FACTORIES

PLATFORMS = ("shopline", "cyberbiz", "bvshop", "custom")
# Shapes of names, hosts and path segments.
_NAME = r"[a-z][a-z0-9-]*"
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_HOST = rf"{_LABEL}(?:\.{_LABEL})+"
_SEGMENT = r"[A-Za-z0-9][A-Za-z0-9\-/]*"
# What can be wrong, in the order in which it is told.
PROBLEMS = ("name", "rawHost", "siteUrl", "productPathSegment", "storeId", "imageCdnHost", "imageCdnHostShape")


class SpecError(ValueError):
    def __init__(self, problem: str, value: str | None = None):
        super().__init__(f"{problem}: {value!r} won't do")
        self.problem = problem


@dataclass(frozen=True)
class Spec:
    name: str
    raw_host: str
    site_url: str
    platform: str = "custom"
    product_path_segment: str = "products"
    catalog_discovery: bool = True
    store_id: str | None = None
    image_cdn_host: str | None = None
    custom_label: str | None = None


def problem(name: Column, raw_host: Column, site_url: Column, platform: Column, segment: Column, store_id: Column, cdn: Column) -> Column:
    """The first of PROBLEMS that rows of specs have, null for sound ones."""
    fits = lambda c, p: F.coalesce(c.rlike(rf"\A(?:{p})\z"), F.lit(False))
    empty = lambda c: c.isNull() | (c == "")
    return (
        F.when(~fits(name, _NAME), "name")
        .when(~fits(raw_host, _HOST), "rawHost")
        .when(~F.coalesce(site_url.rlike(r"\Ahttps?://"), F.lit(False)), "siteUrl")
        .when(~fits(segment, _SEGMENT), "productPathSegment")
        .when((platform == "bvshop") & empty(store_id), "storeId")
        .when((platform == "custom") & empty(cdn), "imageCdnHost")
        .when(cdn.isNotNull() & ~fits(cdn, _HOST), "imageCdnHostShape")
    )


def check(spec: Spec) -> None:
    tests = (
        (re.fullmatch(_NAME, spec.name), spec.name),
        (re.fullmatch(_HOST, spec.raw_host), spec.raw_host),
        (re.match(r"https?://", spec.site_url), spec.site_url),
        (re.fullmatch(_SEGMENT, spec.product_path_segment), spec.product_path_segment),
        (spec.platform != "bvshop" or spec.store_id, spec.store_id),
        (spec.platform != "custom" or spec.image_cdn_host, spec.image_cdn_host),
        (not spec.image_cdn_host or re.fullmatch(_HOST, spec.image_cdn_host), spec.image_cdn_host),
    )
    for name, (good, value) in zip(PROBLEMS, tests):
        if not good:
            raise SpecError(name, value)


def product_url_pattern(spec: Spec) -> str:
    return rf"\Ahttps://{re.escape(spec.raw_host)}/{spec.product_path_segment.strip('/')}/([^/?#]+)"


def render(spec: Spec) -> str:
    """A Python module that declares the source."""
    check(spec)
    known = spec.platform in FACTORIES
    what = FACTORIES.get(spec.platform, "Source")
    imports = sorted({what, "Download", *(() if known else ("CatalogDiscovery", "custom_commerce_platform"))})
    discovery = None if not spec.catalog_discovery else f'CatalogDiscovery({spec.site_url.rstrip("/") + "/sitemap.xml"!r}, PRODUCT_URL)'
    args = [f"name={spec.name!r}", f"raw_host={spec.raw_host!r}", "product_url_pattern=PRODUCT_URL"]
    if known:
        args += [f"store_id={spec.store_id!r}"] if spec.store_id else []
        args += [] if spec.catalog_discovery else ["catalog_discovery=None"]
    else:
        args += [f"commerce_platform=custom_commerce_platform({spec.custom_label or spec.name!r})", f"image_url_hint={'(?i)' + re.escape(spec.image_cdn_host or '') + '/'!r}", f"catalog_discovery={discovery}"]
    # None keeps every image: a start, until the pages are known
    args += ["selector=None", f"download=Download({spec.site_url!r})"]
    lines = [f'"""{spec.name}: a generated declaration; what the engine can\'t know is stated here."""', "", f"from storeloom.operators.platforms import {', '.join(imports)}", "", f"PRODUCT_URL = {product_url_pattern(spec)!r}", "", f"source = {what}(", *(f"    {a}," for a in args), ")", ""]
    return "\n".join(lines)


def spec_of(observation: dict, name: str) -> Spec | None:
    """A spec out of one page's observations; None where they don't support one."""
    found = re.match(r"https?://([^/?#]+)", observation["url"])
    if not found:
        return None
    kind, hosts = observation["platform"]["kind"], observation["image_hosts"]
    if kind == "custom" and not hosts:
        return None
    host = found[1].lower()
    more = {"image_cdn_host": hosts[0]["host"], "custom_label": name} if kind == "custom" else {}
    if kind == "bvshop" and observation.get("store_id"):
        more["store_id"] = observation["store_id"]
    return Spec(name, host, f"https://{host}", kind, observation.get("product_path_segment") or "products", True, **more)


def flags(observation: dict) -> str:
    """The command line that the observations imply."""
    host = re.match(r"https?://([^/?#]+)", observation["url"])
    out = [f"--host {host[1].lower() if host else ''}", f"--platform {observation['platform']['kind']}"]
    out += [f"--segment {observation['product_path_segment']}"] if observation.get("product_path_segment") else []
    if observation["platform"]["kind"] == "custom" and observation["image_hosts"]:
        out.append(f"--cdn {observation['image_hosts'][0]['host']}")
    return "python -m storeloom.operators.scaffold --name <name> " + " ".join(out)


def report(observation: dict, suggestions=()) -> str:
    """The observations as a table of names and values, a line each; lists are written out whole."""
    rows: list[tuple[str, str]] = []
    for name, value in observation.items():
        if name == "platform":
            rows.append(("platform", value["kind"]))
            rows += [("platform by", e) for e in value["evidence"]]
        elif name == "image_hosts":
            rows += [("images from", f"{h['host']} ({h['count']})") for h in value]
        elif isinstance(value, list):
            rows += [(name, str(v)) for v in value]
        elif name != "page_id":
            rows.append((name, "-" if value is None else str(value).lower() if isinstance(value, bool) else str(value)))
    rows += [(f"try {s['symbol']}", s["because"] + (f" ({s['summary']})" if s.get("summary") else "")) for s in suggestions]
    return "\n".join(f"{name}: {value}" for name, value in rows)


def write(path: str, text: str, force: bool = False) -> None:
    """Writes a file, but over an existing one only by force."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w" if force else "x", encoding="utf-8") as f:
        f.write(text)


def run(argv: list[str]) -> tuple[str, int]:
    """The scaffold's command line: what to print, and the exit code."""
    p = argparse.ArgumentParser("scaffold")
    for name in ("name", "host", "site-url", "platform", "segment", "store-id", "cdn", "label", "out"):
        p.add_argument(f"--{name}")
    p.add_argument("--no-catalog", action="store_true")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    platform = a.platform or "custom"
    if platform not in PLATFORMS:
        return f"error: no engine {platform}; there are {', '.join(PLATFORMS)}.", 1
    spec = Spec(a.name or "", a.host or "", a.site_url or f"https://{a.host}", platform, a.segment or ("item" if platform == "bvshop" else "products"), not a.no_catalog, a.store_id, a.cdn, a.label or (a.name if platform == "custom" else None))
    try:
        text = render(spec)
        if a.out:
            write(a.out, text, a.force)
    except (SpecError, FileExistsError) as error:
        return f"error: {error}", 1
    return text, 0


def inspect_html(spark, url: str, html: str, as_json: bool = False) -> str:
    """One page's observations, as JSON or as a report."""
    from storeloom.operators import catalogue, observe

    obs = observe.observe(spark.createDataFrame([(0, url, html)], "page_id long, url string, html string"))
    row = obs.first().asDict(recursive=True)
    told = [r.asDict() for r in observe.suggestions(obs, catalogue.table(spark)).orderBy("at").collect()]
    return json.dumps(row, ensure_ascii=False, indent=2) if as_json else report(row, told) + "\n\n" + flags(row)


if __name__ == "__main__":
    import sys

    text, code = run(sys.argv[1:])
    print(text)
    sys.exit(code)
