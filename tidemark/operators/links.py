"""Links between pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import links


def page_links(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, place, href, target) for each link in a page's raw HTML, in the page's order: the target as
    written, with character references read, and as a URL resolved against the page's base and own URL.

    Pages are read as browsers read them; see ``functions.html``. A null page has no links; a null URL
    resolves as an empty one; a target that is no URL is null as one. A page is worked through by one task, in one go through it.
    """
    kind = pa.schema([("page_id", pa.int64()), ("place", pa.int32()), ("href", pa.string()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [(i, k, *link) for i, url, page in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html")), strict=True) for k, link in enumerate(links(page, url))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kind)], schema=kind)

    none = F.lit("")
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), none).alias("url"), F.coalesce(F.col(html_col).cast("string"), none).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, place int, href string, target string")
