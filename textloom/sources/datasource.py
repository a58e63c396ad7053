"""A Python data source: ``spark.read.format("document_segments").load(path)``.

Files under a local or shared path become segment rows, a partition for every
``files`` files (option, 64 by default). It is a convenience for folders that
all executors see; ``plans.pipeline`` reads any file system Spark knows.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, id string, text string, part string, index int, container_id string, error string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options.get("path", "."), int(options.get("files", "64"))

    def partitions(self):
        found = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs) if os.path.isdir(self.path) else [self.path]
        return [Files(found[k : k + self.step]) for k in range(0, len(found), self.step)] or [Files([])]

    def read(self, partition):
        from textloom import schema as S
        from textloom.sources import docx, pdf

        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            try:
                if data.startswith(b"PK"):
                    n = 0
                    for p in docx.read_paragraphs(data):
                        if p["visible_text"]:
                            yield (path, f"s{n}", p["visible_text"], p["part"], p["local_idx"], p["container_id"], None)
                            n += 1
                elif data.startswith(b"%PDF-"):
                    for k, (text, _, _) in enumerate(pdf.read_pages(data)):
                        if text.strip():
                            yield (path, f"p{k}", text, f"page:{k}", k, None, None)
                else:
                    for name in ("utf-8-sig", "cp1250", "latin-1"):
                        try:
                            yield (path, "s0", data.decode(name), "text", 0, None, None)
                            break
                        except UnicodeDecodeError:
                            continue
            except Exception:
                yield (path, None, None, None, None, None, S.ERROR_DOCX if data.startswith(b"PK") else S.ERROR_PDF)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
