"""Ranking: deep link search, products, media, and elements for a planner."""

from __future__ import annotations

from cloakwork.functions.dialect import Spark, chain, trim, words

# Words and weights that results depend on.
STOP = ("for", "the", "and", "a", "an", "to", "in", "on", "of", "with", "at", "by", "from")
TIERS = ("pro", "max", "plus", "ultra", "air", "mini", "lite")
STRICT_TIERS = ("pro", "max", "ultra", "plus")
ACCESSORIES = ("case", "cover", "sleeve", "skin", "pouch", "bag", "protector", "tempered glass", "adapter", "cable", "charger", "cord", "hub", "dock", "stand", "holder", "mount", "strap", "band", "shell", "guard", "decal", "sticker", "cleaning kit", "replacement", "stylus", "pen")
USED = r"\b(?:refurbished|renewed|pre-owned|used)\b"
MEDIA_STOP = ("the", "and", "for", "with", "a", "an", "to", "in", "on", "of", "it", "play", "watch", "song", "video")


def tokens(d: Spark, x: str, least: int) -> str:
    return d.filter(d.split(x, r"\s+"), "w", f"length(w) >= {least}")


def count(d: Spark, xs: str, test: str) -> str:
    return d.size(d.filter(xs, "w", test))


def deep_score(d: Spark, combined: str, query: str, section: str) -> str:
    """A link's score: 15 for the phrase, 3 for each longer token, more in buried areas."""
    near = f"case {section} when 'Page Footer' then 4 when 'Navigation Bar' then 2 when 'Page Header' then 2 else 0 end"
    return f"(case when contains({combined}, {query}) then 15 else 0 end + 3 * {count(d, tokens(d, query, 3), f'contains({combined}, w)')} + {near})"


def product_query(d: Spark, x: str) -> str:
    return trim(d, chain(d, f"lower({x})", r"^(?:open\s+product:\s*)", r"^(?:please\s+)?(?:open|go\s+to|visit)\s+[a-z0-9.-]+\s*(?:and\s+)?", r"^(?:search(?:\s+for)?|find|buy(?:\s+now)?|order|open|get|add\s*(?:it)?\s*to\s*cart)\s*", r"\s+(?:in|on|at)\s+[a-z0-9.-]+$", r"\s+(?:and\s+)?(?:add\s*(?:it\s*)?to\s*cart|buy(?:\s+now)?|order).*$", r"^(?:open\s+product:\s*)"))


def product_words(d: Spark, clean: str) -> str:
    return d.filter(d.split(clean, r"\s+"), "w", f"(length(w) >= 2 or {d.match('w', '[0-9]')}) and w not in {words(d, STOP)}")


def discriminators(d: Spark, ws: str) -> str:
    return d.filter(ws, "w", f"{d.match('w', '[0-9]')} or w in {words(d, TIERS)}")


def product_score(d: Spark, t: str, clean: str, ws: str, ds: str, sponsored: str, cart: str) -> str:
    """A card's score; 0 where a rule excludes it. ``t`` is the lower-cased title."""
    chips = d.extract_all(t, r"\bm[1-9]\b", 0)
    wanted = d.extract(clean, r"\bm[1-9]\b", 0)
    excluded = [
        f"({d.match(t, r'\b(?:' + '|'.join(ACCESSORIES) + r')\b')} and {count(d, ws, f'w in {words(d, ACCESSORIES)}')} = 0)",
        f"{count(d, ds, f'({d.match('w', '[0-9]')}) and not {d.word_in('w', t)}')} > 0",
        *(f"({d.has(ds, d.lit(w))} and not {d.match(t, rf'\b{w}\b')})" for w in STRICT_TIERS),
        f"({wanted} <> '' and {d.size(chips)} > 0 and not {d.has(chips, wanted)})",
        f"{count(d, ws, d.word_in('w', t))} < least(2, {d.size(ws)})",
    ]
    hit = d.word_in("w", t)
    score = f"""(15 * {count(d, ws, f'{hit} and not {d.has(ds, "w")}')} + 40 * {count(d, ws, f'{hit} and {d.has(ds, "w")}')} + case when {d.size(ds)} > 0 then 30 else 0 end
      - case when {d.match(t, USED)} and not {d.match(clean, USED)} then 35 else 0 end - case when {d.match(t, r'\bmax\b')} and not {d.has(ds, "'max'")} then 10 else 0 end
      - case when {d.match(t, r'\bpro\b')} and not {d.has(ds, "'pro'")} then 5 else 0 end - case when {sponsored} then 20 else 0 end + case when {cart} then 6 else 0 end)"""
    return f"case when {' or '.join(excluded)} then 0 else {score} end"


def media_query(d: Spark, x: str) -> str:
    x = chain(d, f"lower({x})", r"^(?:please\s+)?(?:play|watch|listen(?:\s+to)?|stream|open|search(?:\s+for)?)\s+", r"^(?:the\s+)?(?:song|track|video|music)\s+", r"\s+(?:in|on|at)\s+(?:youtube|spotify|google|web|browser|[a-z0-9.-]+)$")
    x = d.sub_first(x, r"\b(?:by|from|singer|artist)\b", " ")
    return trim(d, chain(d, x, r"\s+(?:and\s+)?(?:play\s+it|play|watch\s+it|watch|listen\s+to\s+it|listen|stream\s+it|stream)\s*$", r"\s+(?:the\s+)?(?:song|track|video|music)\s*$", "^[\"']|[\"']$", (r"[^A-Za-z0-9_\s]", " "), (r"\s+", " ")))


def media_words(d: Spark, clean: str) -> str:
    return d.filter(d.split(clean, r"\s+"), "w", f"length(w) >= 2 and w not in {words(d, MEDIA_STOP)}")


def media_score(d: Spark, t: str, clean: str, ws: str, ad: str) -> str:
    """-100 for an ad, 0 for no match; a match counts its tokens, phrase and completeness."""
    n, hits, phrase = d.size(ws), count(d, ws, f"contains({t}, w)"), f"contains({t}, {clean})"
    enough = f"({phrase} or case when {n} <= 2 then {hits} = {n} else 2 * {hits} >= {n} end)"
    return f"case when {ad} then -100 when {n} = 0 or not {enough} then 0 else 25 * {hits} + case when {phrase} then 50 else 0 end + case when {hits} = {n} then 30 else 0 end end"


def plan_score(d: Spark, goal: str, combined: str, text: str, tag: str) -> str:
    """How well an element fits a goal, by tokens and by the goal's intent."""
    ts = d.filter(d.split(goal, r"[^A-Za-z0-9_]+"), "w", "length(w) > 2")
    boost = lambda word, test, n: f"case when contains({goal}, '{word}') and ({test}) then {n} else 0 end"
    has = lambda w: f"contains({combined}, '{w}')"
    return f"""(3 * {count(d, ts, f'contains({combined}, w)')} + 6 * {count(d, ts, f"{text} <> '' and w = lower({text})")} + {boost('search', f"{tag} = 'input' or {has('search')}", 8)}
      + {boost('order', f"{has('order')} or {has('track')}", 10)} + {boost('cart', has('cart'), 10)} + {boost('profile', f"{has('profile')} or {has('account')}", 10)} + {boost('login', f"{has('login')} or {has('sign in')}", 10)})"""
