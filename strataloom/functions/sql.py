"""The functions under names for ``spark.sql``, and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.functions import html, urls
from strataloom.operators.archive import read_framed
from strataloom.operators.chunking import split_text


@F.udtf(returnType="source: string, body: string")
class ArchiveSections:
    """``LATERAL archive_sections(text)``."""

    def eval(self, text: str) -> Iterator[tuple[str, str | None]]:
        yield from dict(read_framed(text or "")).items()


@F.udtf(returnType="part: int, text: string")
class SplitText:
    """``LATERAL split_text(text, limit)``."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(split_text(text, limit))


@F.udtf(returnType="kind: string, text: string")
class TextSpans:
    """``LATERAL text_spans(text)``."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        yield from urls.tokenize(text)


def register(spark: SparkSession, site: urls.Site = urls.Site()) -> None:
    """Makes ``rich_markdown``, ``extract_assets``, ``classify_url``, ``safe_destination`` and the table functions known to SQL."""
    spark.udf.register("rich_markdown", F.udf(lambda text, answer: html.to_markdown(text, answer, site=site), "string", useArrow=True))
    spark.udf.register("extract_assets", F.udf(lambda text: html.assets(text, site), html.ASSETS_TYPE, useArrow=True))
    spark.udf.register("classify_url", F.udf(lambda url: urls.classify(url, site), f"struct<{urls.CLASS_TYPE}>", useArrow=True))
    spark.udf.register("safe_destination", F.udf(urls.safe_destination, "string", useArrow=True))
    spark.udtf.register("archive_sections", ArchiveSections)
    spark.udtf.register("split_text", SplitText)
    spark.udtf.register("text_spans", TextSpans)
