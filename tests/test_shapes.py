"""Pages of one shape are folded once, and each keeps its own texts, values and places."""

from cloakwork.functions import tree
from cloakwork.operators import attributes, elements

PAGE = "<title>{0} &amp; {1}</title><div class='a{1}'><p>one {0}<p>two<img alt={1}><select name=s{1}><option>{0} {0}<option value=v{1} selected>x</select><textarea>\n{0}</textarea><button><svg aria-label='{0}'></svg>{1}</button></div>"


def test_pages_of_one_shape_are_folded_once(monkeypatch):
    folded = []
    monkeypatch.setattr(tree._Fold, "shape", lambda self, parts, own=tree._Fold.shape: folded.append(parts) or own(self, parts))
    matcher = elements.PAGE.matcher()
    values = [("a", "1"), ("longer", "22"), ("", "3"), ("&lt;", "4"), ("a", "1")]
    pages = [tree.fold(PAGE.format(*v), elements.PAGE, matcher) for v in values]
    # An empty text is none, so its page has a shape of its own only where nothing else stands there.
    assert len(folded) == 1 and pages[0] == pages[4]
    assert [p["title"] for p in pages] == ["a & 1", "longer & 22", " & 3", "< & 4", "a & 1"]
    for (a, b), page in zip(values, pages, strict=True):
        a = a.replace("&lt;", "<")
        select, area, button = page["nodes"]
        assert select["options"] == [{"value": x, "label": x, "selected": False} for x in [f"{a} {a}".strip()]] + [{"value": f"v{b}", "label": "x", "selected": True}]
        assert (area["content"], button["drawing"], page["text"][button["start"] : button["stop"]], select["selector"]) == (a, a, b, f'select[name="s{b}"]')
        assert page == tree.fold(PAGE.format(a.replace("<", "&lt;"), b), elements.PAGE)


def test_few_shapes_are_kept(monkeypatch):
    monkeypatch.setattr(tree, "SHAPES", 6)
    matcher = elements.PAGE.matcher()
    pages = ["<a href=1>x</a>" * n for n in (1, 2, 3, 1)]
    assert [len(tree.fold(p, elements.PAGE, matcher)["nodes"]) for p in pages] == [1, 2, 3, 1] and len(matcher.shapes) == 1


def test_nodes_around_are_given_and_paths_are_made_where_asked_for():
    page = tree.fold("<div class=credit-card><p>a</p></div><p id=x>b</p><i id=email>c</i>", attributes.PAGE)
    assert [(n["node"], n["tag"], n["selector"]) for n in page["nodes"]] == [(0, "div", None), (1, "p", None), (3, "i", None)]
