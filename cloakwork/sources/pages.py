"""Pages: links, headings, visible text and labels out of HTML, without a browser.

Tags are found by patterns; a link's section follows from the last opening and closing tags
of footer, nav and header before it. Layout is unknown here, so everything counts as visible.
"""

from __future__ import annotations

from cloakwork.functions.dialect import Spark, chain, trim, words

# What the scan keeps.
TEXT_LEAST, TEXT_MOST, ELEMENTS, LABEL_MOST = 20, 1500, 60, 90
SENSITIVE_NAME = r"pass|card|cvv|cvc|expir|aadhaar|pan|pin|otp|address|city|state|zip|district|postal|email|mail|phone|tel|mobile|name|recipient|contact"
SENSITIVE_VALUES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\b[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b")


def plain_text(d: Spark, html: str) -> str:
    """A fragment's text on one line."""
    return trim(d, chain(d, html, (r"<[^>]*>", " "), (r"&nbsp;", " "), (r"\s+", " ")))


def title(d: Spark, html: str) -> str:
    return f"coalesce(nullif({plain_text(d, d.extract(html, r'<title[^>]*>([^<]*)</title>'))}, ''), 'Untitled Page')"


def body(d: Spark, html: str) -> str:
    """The page's text: distinct lines of at least two characters outside scripts, styles
    and the footer; if under 20 characters, the start of everything."""
    def visible(part: str) -> str:
        bare = chain(d, part, r"<script[^>]*>[\s\S]*?</script>", r"<style[^>]*>[\s\S]*?</style>", r"<footer[^>]*>[\s\S]*?</footer>", r"<title[^>]*>[^<]*</title>", (r"</?(?:p|div|h[1-6]|li|tr|ul|ol|nav|header|section|article|main|body|br|table|aside|form|head|html)\b[^>]*>", "\n"))
        return d.filter(d.transform(d.split(bare, r"\n"), "x", plain_text(d, "x")), "x", "length(x) >= 2")

    text = d.join(f"array_distinct({visible(html)})" if type(d) is Spark else f"list_transform(list_filter(list_zip({visible(html)}, generate_series(1, len({visible(html)}))), lambda p: list_position({visible(html)}, p[1]) = p[2]), lambda p: p[1])", "\n")
    return f"case when length({text}) < {TEXT_LEAST} then substr({plain_text(d, html)}, 1, {TEXT_MOST}) else {text} end"


def sections(inside) -> str:
    """Where a tag is, given a test of whether an area is open at it."""
    return f"case when {inside('footer')} then 'Page Footer' when {inside('nav')} then 'Navigation Bar' when {inside('header')} then 'Page Header' else 'Main Content' end"


def links(d: Spark, pages: str) -> str:
    """Rows (page_id, i, href, text, section) of all links with an address.

    The HTML is cut at every link. An area is open at a link if more of its opening than of its closing
    tags stand before it: Spark counts each piece once and adds up the counts of the pieces before,
    so a page costs its length; DuckDB's text counts in all that stands before."""
    count = lambda x, t: f"{d.size(d.extract_all(x, f'<{t}[\\s>]', 0))} - {d.size(d.extract_all(x, f'</{t}>', 0))}"
    if type(d) is Spark:
        rows = f"select page_id, i, part from (select page_id, {d.split('html', '<a(?=[^>]*href)')} as parts from {pages}) t {d.each('parts', 'part')}"
        section = sections(lambda t: f"sum({count('part', t)}) over (partition by page_id order by i rows between unbounded preceding and 1 preceding) > 0")
    else:
        cut = f"select page_id, {d.split(d.sub('html', '<a([^>]*href)', chr(1) + '@1'), chr(1))} as parts from {pages}"
        rows = f"select page_id, parts, i, part from ({cut}) t {d.each('parts', 'part')}"
        section = sections(lambda t: f"{count(d.join('parts[1:i]', ''), t)} > 0")
    placed = f"select page_id, i, part, {section} as section from ({rows}) r"
    return f"""select page_id, cast(i - 1 as int) as i, {d.extract('part', "href=[\"']([^\"']*)[\"']")} as href,
      {plain_text(d, d.extract('part', r'^[^>]*>([\s\S]*?)</a>'))} as text, section from ({placed}) p where i > 0"""


def sensitive(d: Spark, attributes: tuple[str, ...], type_: str, value: str) -> str:
    """Is an element sensitive by its type, attributes or value."""
    tests = [f"{type_} in {words(d, ('password', 'email', 'tel'))}"]
    tests += [d.match(a, SENSITIVE_NAME) for a in attributes]
    tests += [d.match(value, p) for p in SENSITIVE_VALUES]
    return "(" + " or ".join(f"coalesce({t}, false)" for t in tests) + ")"
