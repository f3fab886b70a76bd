"""A search connector over recorded hits, as a Python data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordedSearch(DataSource):
    """``spark.read.format("recorded_search").option("hits", json)``: hits are lists by backend; for each query the first
    backend in ``backends`` that has some answers, up to ``most``. Register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "query string, source string, rank int, title string, href string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.hits = json.loads(options.get("hits", "{}"))
        self.backends = [b for b in options.get("backends", "web,video").split(",") if b]
        self.most = int(options.get("most", "10"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in sorted(self.hits)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = self.hits.get(partition.value, {})
        backend = next((b for b in self.backends if found.get(b)), None)
        for rank, hit in enumerate(found.get(backend, [])[: self.most], 1):
            yield partition.value, backend, rank, hit.get("title"), hit.get("href"), hit.get("body")
