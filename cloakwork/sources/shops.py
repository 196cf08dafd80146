"""Shop and video pages, derived from parts by SQL that Spark and DuckDB share: product cards in wrappers and in one
another, prices without pictures, search fields of several kinds, hidden or behind a button, and links to videos
with repeated ones, thumbnails and bare durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.sources import tables


def pages_sql(parts: str = "part") -> str:
    """SQL for (page_id, html)."""
    n = "cast(k as string)"
    field = "case k % 6 when 0 then '<header><input type=text id=top></header>' when 1 then '<input placeholder=\"Find it\"><input name=q>' when 2 then '<form role=search><div><input type=hidden name=z><input name=u' || " + n + " || '></div></form>' when 3 then '<div hidden><input name=q></div><button class=search-button id=open>S</button><textarea name=note></textarea>' when 4 then '<input name=q style=\"display:none\"><a href=\"/search?x\">Find</a>' else '' end"
    card = "'<div class=item><a href=\"/p/' || " + n + " || '\"><img src=x.png></a><b>' || name || '</b><span>₹ ' || cast(k % 900 + 100 as string) || '</span></div>'"
    return f"""select k as page_id, '<html><body>' || {field} || '<main><ul><li class=cell>' || {card} || '</li><li><div>Rs. 50 only</div></li></ul><section>' || case when k % 3 = 0 then '<article><h3>Deal</h3><div><img src=y><p>$ 9</p></div><a href=#>More</a></article>' else '' end
      || '<a class=tile href="/q/' || {n} || '"><img src=z><i>€ 7</i></a><div style="visibility: hidden"><img><a href=#>h</a>$1</div></section>'
      || '<div id=grid><div><a href="/watch?v=a' || {n} || '_x&t=3"><img alt=pic></a><a href="/watch?v=a' || {n} || '_x" title="Clip of ' || name || '">Clip</a></div><div><a href="https://v.example/watch?v=b-' || cast(k % 7 as string) || '">3:45</a><a href="/watch?v=b-' || cast(k % 7 as string) || '" aria-label="Second  one">4:45</a></div><a href="/watch?list=2">no</a><a href="/watch?v=">Bare</a><a href="/watch?v=c9">1:02:03</a></div></main></body></html>' as html
    from (select p_partkey as k, p_name as name from {parts}) p"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, page_id, html): the derived pages and the given ones."""
    tables.dealt(spark, sf_dir, "part", "p_partkey", "p_name").createOrReplaceTempView("cloakwork_shop_part")
    given = tables.dealt(spark, sf_dir, "pages", "page_id", "html").select(F.lit("pages").alias("src"), "page_id", "html")
    return spark.sql(pages_sql("cloakwork_shop_part")).select(F.lit("shops").alias("src"), "page_id", "html").unionByName(given)


ALL_SQL = f"select 'shops' as src, page_id, html from ({pages_sql()}) f union all select 'pages', page_id, html from pages"
