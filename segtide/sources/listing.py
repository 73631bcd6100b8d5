"""File names out of archive listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A text node is what stands between two tags; a comment ends one, as a tag does.
COMMENT = "(?s)<!--.*?-->"
TEXT_NODE = ">([^<]*+)<"


def listing_extract(pages: DataFrame, marker: str) -> DataFrame:
    """One row per text node that contains ``marker``; the whole page is searched.

    The pattern never backtracks, so the work grows with the length of the page.
    """
    nodes = F.regexp_extract_all(F.regexp_replace("html", COMMENT, "<!>"), F.lit(TEXT_NODE), F.lit(1))
    marked = F.filter(nodes, lambda text: F.contains(text, F.lit(marker)))
    return pages.select("page_id", "url", F.explode(marked).alias("node_text"))
