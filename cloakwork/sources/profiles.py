"""Pages whose elements name what they hold by id or class, derived from customers by SQL that Spark
and DuckDB share: values of every kind, wrong ones, names that only contain a kind's word, headings,
and a footer that must not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.sources import forms, tables


def pages_sql(customers: str = "customer") -> str:
    """SQL for (page_id, html)."""
    k = "cast(k as string)"
    digits = lambda n, mod: f"lpad(cast(k % {mod} as string), {n}, '0')"
    parts = (
        f"'<span id=\"val-email\"> user' || {k} || '@shop.example.com </span><h3 class=\"email\">head@example.com</h3><b class=\"e-mail\">none@example.com</b>'",
        f"'<td class=\"cell Mobile\">98765 ' || {digits(5, 100000)} || '</td><div id=\"phone2\">(212) 555-' || {digits(4, 10000)} || '</div><input id=\"phone\" value=\"9876543210\">'",
        f"'<b class=\"cvv\">' || {digits(3, 1000)} || '</b><input id=\"cvc\" value=\"' || {digits(4, 10000)} || '\"><span id=\"cvv-label\">CVV</span>'",
        "'<span class=\"exp-date\">' || lpad(cast(k % 14 as string), 2, '0') || '/' || cast(25 + k % 9 as string) || '</span><input class=\"expiry\" value=\"08/2029\"><p class=\"explain\">8/29</p>'",
        f"'<div id=\"ship-address\">Flat ' || {k} || ', Hill Road\nUpdate location</div><span id=\"city\">Pune</span><span class=\"velocity\">Fast city</span><p class=\"address\">Select your address</p><i id=\"glow-ingress-line2\">' || case k % 3 when 0 then 'Deliver to Noida 201301' when 1 then 'update' else 'in Agra' end || '</i>'",
        f"'<code id=\"otp-code\">' || {digits(6, 1000000)} || '</code><em class=\"otp-val big\">12</em><input class=\"otp-code\" value=\"749210\">'",
        f"'<i class=\"upi-id\">user' || {k} || '@okaxis</i><span id=\"ifsc\">HDFC0' || {digits(6, 1000000)} || '</span><span id=\"account-num\">' || lpad({k}, 12, '73') || '</span><u class=\"bank-ac\">12345678</u>'",
        f"'<span class=\"passport\">J1' || {digits(1, 10)} || ' ' || {digits(4, 10000)} || '7</span><span class=\"cc-number\">' || {forms._card('k')} || '</span><span id=\"card_num\">1234</span>'",
        f"'<span class=\"aadhaar-val\">' || case when k % 2 = 0 then '4321 8765 2109' else '4321 8765 2108' end || '</span><span class=\"company\">ABCDE ' || {digits(4, 10000)} || ' F</span><s id=\"val-password\">••••••</s><span class=\"password\">secret' || {k} || '</span>'",
        f"'<p style=\"border-left:2px\">Annual CTC is ' || {k} || ' LPA</p><p style=\"border-left: red\">civil suit of ' || {k} || '</p><p style=\"border-left: red\">litigation pending</p>'",
        f"'<div class=\"credit-card\"><div><p>Valid <b>08/3' || cast(k % 10 as string) || '</b></p></div><i>12/31</i></div><section class=Dossier><p>Salary of ' || {k} || ' lakh <b>per year</b></p><p>FIR no. <i>' || {k} || '</i> <b>of Pune</b></p></section>'",
        f"'<div id=email-box class=\"wide\"><span>mail</span> <i>box' || {k} || '@shop.example.com</i></div><div class=badge><span id=val-email>badge@example.com</span></div><form role=search><div class=address>9 Search Road</div></form><div hidden><b id=val-email>hidden@example.com</b></div><div class=aadhaar><b>4321 8765 2109</b></div>'",
    )
    return f"select k as page_id, '<html><body>' || {' || '.join(parts)} || '<footer><span id=\"email\">foot@example.com</span></footer></body></html>' as html from (select c_custkey as k from {customers}) c"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.dealt(spark, sf_dir, "customer", "c_custkey").createOrReplaceTempView("cloakwork_customer")
    return spark.sql(pages_sql("cloakwork_customer"))
