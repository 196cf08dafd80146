"""Pages with forms, derived from customers by SQL that Spark and DuckDB share.

The given pages hold links only. These hold inputs of all kinds, code cells, a select, buttons
with and without text, elements by role, leaf texts with numbers, attributes in either quotes and in none,
areas in areas, elements without ends, hidden ones, and a footer and a script that must not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.sources import synthetic, tables


def pages_sql(customers: str = "customer") -> str:
    """SQL for (page_id, html)."""
    k = "cast(k as string)"
    cells = "repeat('<input maxlength=\"1\" value=\"7\">', cast(k % 10 as int))"
    return f"""select k as page_id,
      '<html><head><title> Shop ' || {k} || ' </title><script>var s = "<button>never</button>";</script></head><body>'
      || '<header><a href="/home">Home</a> <button id="btn-nav-orders">My Orders</button> <button id="btn-nav-cart" aria-label="Open cart">Cart (' || {k} || ')</button></header>'
      || '<div id="main" class="page wide"><p>Customer card ' || {_card('k')} || '</p><span>PAN ABCDE' || lpad(cast(k % 10000 as string), 4, '0') || 'F noted</span><b>Noida 2013' || lpad(cast(k % 100 as string), 2, '0') || '</b><td>update location 201301</td>'
      || '<form><input type="text" name="full_name" placeholder="Enter recipient name" value="Asha ' || {k} || '"> <input type="email" id="mail' || {k} || '" placeholder="name@domain.com"> <input name="q" role="searchbox" placeholder="Search products">'
      || '<input type="password" id="pw" value="hidden"> <textarea name="notes" title="Your notes">call 98765' || lpad(cast(k % 100000 as string), 5, '0') || '</textarea>'
      || '<div class="otp-inputs">' || {cells} || '</div><input size="1" name="middle"> <select name="city" id="city' || {k} || '"><option value="">Choose</option><option value="pnq">Pune</option><option value="del">New Delhi</option><option value="c' || {k} || '">Town ' || {k} || '</option></select>'
      || '<button type="submit" class="btn main" id="pay">Proceed to checkout</button> <button><img src="/i.png" alt="Track parcel"></button> <button><svg aria-label="Wish list"></svg></button>'
      || '<div role="button" class="chip" tabindex="0">Model ' || {k} || ' <b>Pro</b></div> <span tabindex="-1">not one</span> <a href="/item/' || {k} || '" title="See details">Ring ' || cast(k % 17 as string) || '</a> <a>no address</a> <div onclick="go()">More&nbsp;offers</div></form></div>'
      || '<section class="verification-area"><div><div></div></div><p>Code<p>sent to a.b' || {k} || '@example.com<input type=''password'' id=''k1'' value="hunter2-Zebra' || {k} || '"><input type=password name=k2 value=hunter3-Zebra' || {k} || '>'
      || '<div><div class=''inner''></div>' || repeat('<input maxlength=''1'' value=8>', cast(k % 3 as int)) || '</div></section><div class=otp-row>' || repeat('<input class=cell value=5>', cast(k % 12 as int)) || '</div>'
      || '<ul class="menu wide"><li>One<li>Two <a class="go:to" href=/two/' || {k} || ' title=''Second &amp; last''>Go &lt;two&gt;</a><li><a class=go href=/three><i>Three</i> here</a></ul><div hidden><button>Unseen</button><a href="/unseen">Unseen</a></div>'
      || '<div style="display: none"><input name="trap" value="trap"></div><div class="card-row"><span style="cursor:pointer">Tap ' || {k} || '</span><span style="cursor: pointer"><b>Not</b> a <i>leaf</i></span></div>'
      || '<table><tbody><tr><td><strong>Parcel ' || {k} || '</strong> on its way<td><a href=/track role=link>Follow</a><tr><td>None</table><label for=q2>Find in <input type=search id=q2 placeholder=''Find it''></label><div class=tail>'
      || '<footer><a href="/policy">Cancellation policy</a><button>Foot</button></footer></div></body></html>' as html
    from (select c_custkey as k from {customers}) c"""


def _card(k: str) -> str:
    """A card number of 16 digits, right for every third customer, and one by its brand's prefix alone for the others."""
    body = f"'453289214455' || lpad(cast({k} % 1000 as string), 3, '0')"
    return f"{body} || cast(({synthetic._luhn_digit(f'({body})', 15)} + case when {k} % 3 = 0 then 0 else 1 end) % 10 as string)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.dealt(spark, sf_dir, "customer", "c_custkey").createOrReplaceTempView("cloakwork_customer")
    return spark.sql(pages_sql("cloakwork_customer"))


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, page_id, html): the derived pages and the given ones."""
    given = tables.dealt(spark, sf_dir, "pages", "page_id", "html").select(F.lit("pages").alias("src"), "page_id", "html")
    return pages(spark, sf_dir).select(F.lit("forms").alias("src"), "page_id", "html").unionByName(given)


ALL_SQL = f"select 'forms' as src, page_id, html from ({pages_sql()}) f union all select 'pages', page_id, html from pages"
