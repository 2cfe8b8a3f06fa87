"""A Python data source of candidate products, for ``spark.read.format("storeloom_candidates")``."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, rows):
        self.rows = rows

    def partitions(self):
        size = 10_000
        return [InputPartition((a, self.rows[a : a + size])) for a in range(0, max(len(self.rows), 1), size)]

    def read(self, partition):
        first, rows = partition.value
        for i, row in enumerate(rows):
            yield first + i, row[0], row[1]


class CandidateSource(DataSource):
    """Option ``rows``: a JSON array of [product_url, product_id], in order of priority."""

    @classmethod
    def name(cls):
        return "storeloom_candidates"

    def schema(self):
        return "pos long, product_url string, product_id string"

    def reader(self, schema):
        return _Reader(json.loads(self.options.get("rows", "[]")))
