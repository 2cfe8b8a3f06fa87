"""Command line: what one stored or fetched page shows of its site, and the declaration that it implies."""

from __future__ import annotations

import argparse
import sys

from storeloom.operators import observe, scaffold


def run(argv: list[str], fetch=None, spark=None) -> tuple[str, int]:
    """``fetch``: a function from a URL to its HTML, for pages that no --html file holds."""
    p = argparse.ArgumentParser("inspect")
    p.add_argument("url")
    p.add_argument("--html", help="a file with the page")
    p.add_argument("--json", action="store_true")
    p.add_argument("--scaffold", metavar="NAME", help="print the declaration of a source of this name")
    a = p.parse_args(argv)
    if a.html:
        with open(a.html, encoding="utf-8") as f:
            html = f.read()
    elif fetch:
        html = fetch(a.url)
    else:
        return "error: no --html file, and nothing to fetch with.", 1
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if not a.scaffold:
        return scaffold.inspect_html(spark, a.url, html, a.json), 0
    obs = observe.observe(spark.createDataFrame([(0, a.url, html)], "page_id long, url string, html string")).first().asDict(recursive=True)
    spec = scaffold.spec_of(obs, a.scaffold)
    if spec is None:
        return "error: the page shows too little for a declaration.", 1
    try:
        return scaffold.render(spec), 0
    except scaffold.SpecError as error:
        return f"error: {error}", 1


if __name__ == "__main__":
    text, code = run(sys.argv[1:])
    print(text)
    sys.exit(code)
