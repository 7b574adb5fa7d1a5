"""A paged JSON service as a Spark data source: one input partition per page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.fields = [f.name for f in schema.fields]
        self.url, self.items = options["url"], options.get("items", "activities")
        self.limit = int(options.get("limit", 1000))
        self.query = dict(p.split("=", 1) for p in options.get("query", "").split("&") if "=" in p)

    def _get(self, offset: int, limit: int) -> dict:
        with urlopen(f"{self.url}?{urlencode(self.query | {'offset': offset, 'limit': limit})}", timeout=60) as answer:
            return json.load(answer)

    def partitions(self) -> list[Page]:
        total = int(self._get(0, 1)["page_meta"]["total_count"])
        return [Page(o) for o in range(0, total, self.limit)]

    def read(self, partition: Page) -> Iterator[tuple]:
        # A failed page raises, so Spark retries it and no rows are lost silently.
        for item in self._get(partition.offset, self.limit)[self.items]:
            value = [item.get(f) for f in self.fields]
            yield tuple(v if v is None or isinstance(v, str) else str(v) for v in value)


class PagedSource(DataSource):
    """``spark.read.format("paged_json").schema(<string columns>).options(url=..., items=..., limit=..., query="a=b&c=d")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "molecule_chembl_id string, canonical_smiles string, standard_type string, standard_value string, standard_units string, assay_description string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
