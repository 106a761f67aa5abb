"""Table functions for SQL callers: chunk_markdown(path, raw) and extract_links(path, raw)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..session import ship
from . import chunk, links
from .frontmatter import parse


@udtf(returnType="unit_kind string, ordinal int, section string, chunk_id string, content string, search_text string")
class ChunkMarkdown:
    """The units of one document."""

    def eval(self, path: str, raw: str) -> Iterator[tuple]:
        if path is not None and raw is not None:
            for u in chunk.units(path, *parse(raw), 0):
                yield u["unit_kind"], u["ordinal"], u["section"], u["chunk_id"], u["content"], u["search_text"]


@udtf(returnType="to_path string, relation_type string, section_source string")
class ExtractLinks:
    """The distinct edges of one document."""

    def eval(self, path: str, raw: str) -> Iterator[tuple]:
        if path is not None and raw is not None:
            yield from links.edges(path, *parse(raw))[0]


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
    spark.udtf.register("extract_links", ExtractLinks)
