"""Declarations of sources: what a site's engine gives by default, and what a source states itself.

An argument left out takes the engine's default; None means deliberately none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from storeloom.functions import urls as U
from storeloom.operators import images
from storeloom.streaming.progress import PHASES

UNSET: Any = type("Unset", (), {"__repr__": lambda self: "UNSET"})()

# The strategies by which a source's pages are read.
SOURCE_METHODS = ("html-direct", "sitemap-jsonld", "shopline-jsonld-llm", "cyberbiz-jsonld-llm")


@dataclass(frozen=True)
class CommercePlatform:
    kind: str
    label: str


SHOPLINE, CYBERBIZ, BVSHOP = CommercePlatform("shopline", "SHOPLINE"), CommercePlatform("cyberbiz", "CYBERBIZ"), CommercePlatform("bvshop", "BV SHOP")


def custom_commerce_platform(label: str) -> CommercePlatform:
    return CommercePlatform("custom", label)


@dataclass(frozen=True)
class CatalogDiscovery:
    url: str
    product_url_pattern: str
    kind: str = "sitemap"
    excluded_slug_patterns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Download:
    site_url: str
    product_url_for_slug: Callable | None = None


@dataclass(frozen=True)
class Source:
    name: str
    raw_host: str
    commerce_platform: CommercePlatform
    image_url_hint: str
    selector: Callable | None
    catalog_discovery: CatalogDiscovery | None
    product_url_pattern: str | None = None
    phases: tuple[str, ...] = PHASES
    artifact_context: Callable | None = None
    structured_facts: Callable | None = None
    download: Download | None = None
    stage: Callable | None = None
    reconcile: Callable | None = None
    html_fallback_paths: Callable | None = None
    more: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.stage is not None and self.download is None:
            raise ValueError("a source with a stage needs a download: staging rebuilds product URLs from it")


def default_sitemap_url(raw_host: str, site_url: str | None = None) -> str:
    return (site_url or f"https://{raw_host}").rstrip("/") + "/sitemap.xml"


def _discovery(raw_host: str, pattern: str, given: Any, download: Download | None) -> CatalogDiscovery | None:
    if given is None:
        return None
    stated = {} if given is UNSET else given
    return CatalogDiscovery(stated.get("url") or default_sitemap_url(raw_host, download and download.site_url), stated.get("product_url_pattern") or pattern, "sitemap", stated.get("excluded_slug_patterns"))


def _define(platform: CommercePlatform, hint: str, default_selector, name: str, raw_host: str, product_url_pattern: str, *, catalog_discovery: Any = UNSET, selector: Any = UNSET, image_url_hint: str | None = None, download: Download | None = None, **more) -> Source:
    chosen = default_selector if selector is UNSET else selector
    return Source(name, raw_host, platform, image_url_hint or hint, chosen, _discovery(raw_host, product_url_pattern, catalog_discovery, download), product_url_pattern, download=download, **more)


def define_shopline_source(name: str, raw_host: str, product_url_pattern: str, **more) -> Source:
    """A SHOPLINE site: its two image hosts, the size-aware selector, its sitemap."""
    return _define(SHOPLINE, U.SHOPLINE_HINT, images.shopline, name, raw_host, product_url_pattern, **more)


def define_cyberbiz_source(name: str, raw_host: str, product_url_pattern: str, *, selector, **more) -> Source:
    """A CYBERBIZ site. Its selector depends on the site, so it has no default."""
    return _define(CYBERBIZ, U.CYBERBIZ_HINT, None, name, raw_host, product_url_pattern, selector=selector, **more)


def define_bvshop_source(name: str, raw_host: str, product_url_pattern: str, store_id: str, **more) -> Source:
    """A BV SHOP site; the store's id is part of its image paths."""
    return _define(BVSHOP, U.bvshop_folder(store_id, "product|ckeditor"), partial(images.bvshop, store_id=store_id), name, raw_host, product_url_pattern, **more)


def sources_table(spark, sources):
    """One row a source: (name, raw_host, kind, label, image_url_hint, product_url_pattern, sitemap_url)."""
    rows = [(s.name, s.raw_host, s.commerce_platform.kind, s.commerce_platform.label, s.image_url_hint, s.product_url_pattern, s.catalog_discovery and s.catalog_discovery.url) for s in sources]
    return spark.createDataFrame(rows, "name string, raw_host string, kind string, label string, image_url_hint string, product_url_pattern string, sitemap_url string")
