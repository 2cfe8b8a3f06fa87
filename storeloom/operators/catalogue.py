"""What the library offers, as a table that is read off its modules, so that it can't go stale."""

from __future__ import annotations

import argparse
import functools
import importlib
import inspect
import json
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Axes and the modules that make them, in the order of a report.
AXES = {
    "platform": ("storeloom.operators.platforms",),
    "discovery": ("storeloom.operators.discovery",),
    "http": ("storeloom.sources.http", "storeloom.operators.robots", "storeloom.streaming.pacing"),
    "storage": ("storeloom.sources.storage", "storeloom.streaming.progress"),
    "images": ("storeloom.operators.images",),
    "artifact-context": ("storeloom.operators.artifacts",),
    "ocr": ("storeloom.operators.ocr", "storeloom.sources.recogniser"),
    "llm": ("storeloom.sources.model_client",),
    "pages": ("storeloom.operators.observe", "storeloom.operators.stages"),
    "functions": ("storeloom.functions.text", "storeloom.functions.urls", "storeloom.functions.numbers", "storeloom.functions.jsonx"),
}
SCHEMA = "symbol string, axis string, summary string"


def entries() -> list[tuple[str, str, str]]:
    """(symbol, axis, summary) of every public function and class of the axes' modules."""
    out = []
    for axis, modules in AXES.items():
        for module in map(importlib.import_module, modules):
            for name, value in vars(module).items():
                own = (inspect.isfunction(value) or inspect.isclass(value)) and value.__module__ == module.__name__
                if own and not name.startswith("_"):
                    text = value.__doc__ or name.replace("_", " ")
                    out.append((name, axis, text.strip().splitlines()[0]))
    return out


def table(spark) -> DataFrame:
    return spark.createDataFrame(entries(), SCHEMA)


def on_axis(catalogue: DataFrame, axis: str) -> DataFrame:
    return catalogue.where(F.col("axis") == axis)


def search(catalogue: DataFrame, text: str, *others: str) -> DataFrame:
    """Entries whose symbol or summary holds one of the texts, in any case; each entry once, entries alike as often as they stand there."""
    held = [F.contains(F.lower(c), F.lit(t.lower())) for t in (text, *others) for c in ("symbol", "summary")]
    return catalogue.where(functools.reduce(operator.or_, held))


def matching(catalogue: DataFrame, axis: str, text: str) -> DataFrame:
    """What is both on the axis and found by the text."""
    return on_axis(catalogue, axis).join(search(catalogue, text).select("symbol").distinct(), "symbol", "left_semi")


def parity(catalogue: DataFrame, exported: DataFrame) -> DataFrame:
    """(symbol, missing): symbols that are exported but not in the catalogue, or the other way round."""
    a, b = catalogue.select("symbol").distinct(), exported.select("symbol").distinct()
    return b.exceptAll(a).select("symbol", F.lit("catalogue").alias("missing")).unionAll(a.exceptAll(b).select("symbol", F.lit("exports").alias("missing")))


def grouped(rows: list[tuple[str, str, str]]) -> str:
    width = max((len(r[0]) for r in rows), default=0)
    lines: list[str] = []
    for axis in AXES:
        if mine := [r for r in rows if r[1] == axis]:
            lines += ["", axis, "-" * len(axis), *(f"  {s:<{width}}  {text}" for s, _, text in mine)]
    return "\n".join(lines).lstrip("\n")


def run(argv: list[str]) -> tuple[str, int]:
    """The command line: what to print, and the exit code."""
    parser = argparse.ArgumentParser("catalogue")
    parser.add_argument("-a", "--axis")
    parser.add_argument("-s", "--search")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    rows = everything = entries()
    if args.axis is not None:
        if args.axis not in AXES:
            return f"error: no axis {args.axis}; there are {', '.join(AXES)}.", 1
        rows = [r for r in rows if r[1] == args.axis]
    if args.search is not None:
        low = args.search.lower()
        rows = [r for r in rows if low in r[0].lower() or low in r[2].lower()]
    if args.json:
        return json.dumps([dict(zip(("symbol", "axis", "summary"), r)) for r in rows], indent=2, ensure_ascii=False), 0
    if not rows:
        return "Nothing here covers that yet.", 0
    return f"{len(rows)} of {len(everything)} entries\n{grouped(rows)}", 0
