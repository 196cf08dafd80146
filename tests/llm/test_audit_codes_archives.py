"""Operators 11 to 13 against brute force, on odd tables, and archives read back."""

import hashlib
import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import filter_audit, jobs, vector_codes, warc

LABELS = "doc_id long, quality int, toxic int"


# Operator 13


def failing(rows):
    """Letters that each row fails, by plain Python."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, *_ in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[at] == 1} for at in (0, 1))
    fails, out = failing(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0] in good, r[0] in toxic) for f, r in zip(fails, rows, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in own if letter in x[0] and not x[0] & before]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [sum(not f & {*before, letter} for f, *_ in own), len(gone), sum(letter in f and bool(f & before) for f, *_ in own), sum(f == {letter} for f, *_ in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_is_that_of_brute_force(spark, odd, wide):
    jobs.prepare(spark)
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (8, 1, 1), (9, None, 1), (None, 1, 1), (20, 1, None), (15, 1, 0)]
    many = " ".join(f"w{i}" for i in range(220))
    more = [(100 + i, t, "en", "web", 0) for i, t in enumerate((many, many, many + " #", many.upper(), "a b " * 150, "A B " * 150, many + " x"))]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    for table in (docs, wide):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
        assert audited(table, spark.createDataFrame(labels, LABELS)) == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark, odd):
    jobs.prepare(spark)
    assert audited(odd.where("false"), spark.createDataFrame([], LABELS)) == {}
    assert len(audited(odd, spark.createDataFrame([], LABELS))) == 600 * 3


# Operator 11


def brute_codes(rows, rounds=2, positions=16, entries=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, ""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept.sort(key=key)
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    width = -(-length // positions)
    cut = lambda v: [tuple([*v, *[0] * (width * positions - length)][j * width : (j + 1) * width]) for j in range(positions)]
    first = []
    for i, v in kept:
        if not first or first[-1][0] != i:
            first.append((i, v))
    books = [[cut(v)[j] for _, v in first[:entries]] for j in range(positions)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (away(p, book[e]), e))
    for _ in range(rounds):
        for j in range(positions):
            own = [[] for _ in books[j]]
            for _, v in kept:
                p = cut(v)[j]
                own[nearest(p, books[j])].append(p)
            books[j] = [tuple(sum(c) // len(ps) for c in zip(*ps, strict=True)) if ps else e for e, ps in zip(books[j], own, strict=True)]
    out = {}
    for i, v in kept:
        code = [nearest(p, book) for p, book in zip(cut(v), books, strict=True)]
        out.setdefault(i, set()).add(("".join(f"{c:02x}" for c in code), min(sum(away(p, books[j][code[j]]) for j, p in enumerate(cut(v))), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def codes(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    books = vector_codes.fit(table)
    out = {}
    for r in vector_codes.encode(table, books).collect():
        out.setdefault(r["vec_id"], set()).add((r["code"], r["error"]))
    return out, books.sha256() if books else ""


def vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width)) * scale
    return [(int(i), [float(x) for x in np.float32(centres[i % 9] + rng.normal(size=width) * scale / (1 + i % 5))], int(i % 3)) for i in rng.permutation(n)]


@pytest.mark.parametrize("rows", [vectors(700, 64, 1), vectors(150, 32, 2, 0.02), vectors(40, 16, 3), vectors(90, 20, 4), vectors(100, 16, 5, 1e7)], ids=["clusters", "ties", "few", "undivided", "great"])
def test_codes_are_those_of_brute_force(spark, rows):
    jobs.prepare(spark)
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_odd_vectors(spark):
    jobs.prepare(spark)
    plain = vectors(100, 16, 6)
    rows = plain + plain[:30] + [(7, [1.0] * 16, None), (None, [0.5] * 16, 1), (None, [0.25] * 16, 1), (500, None, 1), (501, [], 1), (502, [1.0] * 15 + [None], 1), (503, [float("nan")] * 16, 2), (504, [float("inf")] + [0.0] * 15, 2), (505, [1.0] * 8, 2)]
    assert codes(spark, rows) == brute_codes(rows)
    assert codes(spark, []) == ({}, "")
    far = [(i, [1e20 * (i % 7)] * 16, 0) for i in range(80)]
    assert codes(spark, far, "double") == brute_codes(far)


def test_trees_assign_as_a_dense_comparison_does():
    rng = np.random.default_rng(8)
    for n, k, width, spread in ((1, 1, 1, 5), (9, 3, 2, 2), (1000, 64, 4, 300), (777, 50, 3, 3), (4096, 64, 1, 40)):
        points, entries = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (k, width))
        sums, counts, code = vector_codes.assign(points, entries, vector_codes.Tree(entries, 1))
        want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (code == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def test_decoded_vectors_are_near(spark):
    jobs.prepare(spark)
    rows = vectors(300, 32, 9)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit(table)
    own = {i: v for i, v, _ in rows}
    for r in vector_codes.decode(vector_codes.encode(table, books), books).collect():
        away = sum((math.floor(256 * a) - round(256 * b)) ** 2 for a, b in zip(own[r["vec_id"]], r["approximation"], strict=True))
        assert away == r["error"]


def test_the_hot_join_is_a_left_join(spark):
    jobs.prepare(spark)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else 1 if i % 2 else i) for i in range(3000)], "i long, k long")
    values = spark.createDataFrame([(None, "none"), (1, "one"), (4, "four"), (9999, "other")], "k long, v string")
    got = {r["i"]: r["v"] for r in jobs.hot_join(rows, values, "k").collect()}
    assert len(got) == 3000 and got == {i: "none" if i % 5 == 0 else "one" if i % 2 else "four" if i == 4 else None for i in range(3000)}


# Operator 12


def brute_records(rows, least=1000):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    best = {}
    for i, b in data:
        if i is not None:
            best[b] = max(i, best.get(b, i))
    out = []
    for i, b in data:
        revisit = len(b) >= least and b in best and best[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[b] if revisit else None))
    return sorted(out, key=repr)


LONG = "<p>é à ß</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
PAGES = [
    (1, "http://a.example/", LONG), (2, "http://b.example/", LONG), (9, "http://c.example/x y\r\nInjected: yes", LONG), (3, None, None), (4, "", ""), (5, "http://d.example/", "short"), (6, "http://e.example/", "short"),
    (7, "u", "\r\n" * 700), (8, "u", "\r\n" * 700), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "x" * 1000), (13, "u", "x" * 1000), (14, "u", "é" * 500), (15, "u", "é" * 500),
    (16, "u", "\r\n\r\n"), (17, "u", "a\r"), (18, "u", "\n\r\n"), (19, "u", "\r\r\n\r\r\n\r\n"), (None, "u", LONG), (None, None, "y" * 2000), (None, None, "y" * 2000), (20, "u", "z" * 3_000_000), (21, "v", "z" * 3_000_000), (22, "w", "w" * 1500), (22, "w", "w" * 1500), (21, "w", "w" * 1500),
]


def read_back(spark, pages, tmp_path, **kw):
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, **kw)
    return path, warc.read_archives(spark, path)


def test_archives_say_what_was_written(spark, tmp_path):
    jobs.prepare(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("record_type", "payload", "original", "value", "d", "p")}).repartition(3)
    path, records = read_back(spark, pages, tmp_path)
    rows = records.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == brute_records(PAGES)
    html = {}
    for i, _, h in PAGES:
        html.setdefault(i, set()).add(h or "")
    assert all(r["payload"] in html[r["page_id"]] if r["record_type"] == "response" else r["payload"] is None for r in rows)
    full = warc.with_payloads(records).collect()
    assert len(full) == len(PAGES) and all(r["payload"] in html[r["page_id"]] for r in full)
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[9] == "http://c.example/x%20y%0D%0AInjected:%20yes" and urls[3] is None and urls[1] == "http://a.example/"


def test_archives_are_gzipped_warc_files(spark, tmp_path):
    import gzip

    jobs.prepare(spark)
    path, _ = read_back(spark, spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1), tmp_path, date="2024-05-06T07:08:09Z")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "archives").glob("*.gz")))
    records = list(warc.Reader().feed(data))
    assert [h["warc-type"] for h, _ in records].count("revisit") == 2 and all(h["warc-date"] == "2024-05-06T07:08:09Z" for h, _ in records)
    bare = next((h, b) for h, b in records if h["warc-type"] == "revisit")
    assert bare[0]["warc-refers-to"] == "<urn:page:9>" and bare[0]["warc-profile"].endswith("identical-payload-digest") and bare[1].endswith(b"\r\n\r\n") and int(bare[0]["content-length"]) == len(bare[1])


def test_broken_archives_are_errors(spark, tmp_path):
    jobs.prepare(spark)
    path, _ = read_back(spark, spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1), tmp_path)
    whole = b"".join(__import__("gzip").decompress(f.read_bytes()) for f in sorted((tmp_path / "archives").glob("*.gz")))
    for name, data in (("cut", whole[: len(whole) // 3]), ("changed", whole.replace(b"<p>", b"<q>", 1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_bytes(data)
        with pytest.raises(Exception, match="ends within|not what its record states"):
            warc.read_archives(spark, str(tmp_path / name)).collect()


def test_records_come_out_of_any_pieces():
    block = b"x\r\n\r\ny"
    data = (b"WARC/1.1\r\nA: 1\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") * 3
    for size in (1, 2, 3, 7, 50, 1000):
        reader, found = warc.Reader(), []
        for at in range(0, len(data), size):
            found += reader.feed(data[at : at + size])
        assert [b for _, b in found] == [block] * 3 and reader.size == 0


def test_no_pages_no_records(spark, tmp_path):
    jobs.prepare(spark)
    _, records = read_back(spark, spark.createDataFrame([], "page_id long, url string, html string"), tmp_path)
    assert records.count() == 0
