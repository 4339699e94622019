import random
import re
import time

import pytest

from wayfold.llm.html_layout import ALIGNED, extract, extract_pages


def text(page):
    return extract(page)[1]


def test_implied_tags_blocks_and_lists():
    assert text("<p>a<p>b<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>tail<br>z") == "a\n\nb\n\n- one\n- two\n  3. x\n  4. y\n\ntail\nz"
    assert text("<div>a</div><div>b</div>c <b>d</b>  e") == "a\nb\nc d e"
    assert text("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"
    assert text("<blockquote><p>q</blockquote>after") == "  q\n\nafter"


def test_hidden_things_are_left_out():
    page = "<head><title>T &amp; U</title><style>x</style></head><body><script>var a='</p>'</script><p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no</p><noscript>no</noscript><template>no</template><!-- no -->yes"
    assert extract(page) == ("T & U", "yes")


def test_tables_are_aligned():
    assert text("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>a longer name<td>10</table>") == "Name           Qty\napple          3\na longer name  10"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>") == "a  b\n   c\nwide"
    assert text("<table><tfoot><tr><td>foot</tfoot><tbody><tr><td>body</tbody><thead><tr><td>head</thead></table>") == "head\nbody\nfoot"


def test_preformatted_entities_and_broken_markup():
    assert text("<pre>\n a  b\n  c</pre>") == " a  b\n  c"
    assert text("&lt;x&gt; &#233; &amp") == "<x> é &"
    for page in ("<", "<a href=", '<a href="x>y', "</", "<p", "<!--", "<![CDATA[x", "</div></p></table>ok", "<table><tr><td>x</div></table>y", "<b><p>x</b>y</p>", "<select><option>a<option>b</select>", "<p>" * 5000 + "deep", "<div>" * 5000 + "deep"):
        assert isinstance(text(page), str)
    assert text("<div>" * 5000 + "deep") == "deep"
    assert "deep" in text("<table><tr><td>" * 50 + "deep")


def test_an_unclosed_quote_ends_with_its_tag():
    assert text('<a href="x>y</a> rest') == "y rest"
    assert text("<p title=don't>a<p title='b>c'>d<i x=\"e\">f</i>") == "a\n\ndf"


def test_visibility_is_inherited_and_overridden():
    assert text("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<ul><li>no<li style='visibility:visible'>one</ul></div>two") == "yes\n\n- one\n\ntwo"
    assert text("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes<tr style='visibility:visible'><td>a<td>b</table>") == "   yes\na  b"
    assert text("<pre style='visibility:hidden'>no<b style='visibility:visible'>yes</b></pre>") == "yes"


@pytest.mark.parametrize("page", ["<table><tr><td>" * 5000 + "deep", "<table><tr><td>a<td>" * 5000 + "deep", "<blockquote>" * 20_000 + "deep", "<ul><li>x" * 5000 + "deep", "<b><div>" * 20_000 + "</b>" * 20_000 + "deep", "<p>" + "<span>" * 20_000 + "<div>" * 20_000 + "deep"], ids=lambda p: p[:8])
def test_depth_loses_nothing_and_costs_little(page):
    began = time.monotonic()
    got = text(page)
    assert got.endswith("deep") and len(got) < 20 * len(page) and time.monotonic() - began < 20


def test_hidden_text_stays_hidden_at_any_depth():
    assert text("<div>" * 3000 + "<p hidden>no" + "<span>" * 3000 + "no</p>" + "yes") == "yes"


def test_layout_adds_a_bounded_amount():
    page = "<table>" + "<tr><td rowspan=1000>x" * 2000
    assert len(text(page)) < 600 * 2000 and text(page).count("x") == 2000
    wide = "<table>" + ("<tr>" + "<td colspan=1000>x" * 200) * 200
    assert text(wide).count("x") == 200 * 200
    nested = "<table><tr><td>a<td>" * (ALIGNED + 4) + "z"
    assert text(nested).split() == ["a"] * (ALIGNED + 4) + ["z"]


# -- a second renderer, recursive, for small trees of elements that need no repair ----------------------------------------------

BLOCKS, MARGINS = {"div", "p", "ul", "ol", "blockquote"}, {"p", "ul", "ol", "blockquote"}


def small_tree(r: random.Random, depth: int, inside: str = "div"):
    """(name, hidden, children or text)"""
    if depth == 0 or (inside not in ("ul", "ol") and r.random() < 0.4):
        return r.choice(["x", " y ", "zz top", "  ", "w\n"])
    allowed = ["li"] if inside in ("ul", "ol") else ["b", "span"] if inside in ("p", "b", "span") else ["div", "p", "b", "span", "ul", "ol", "blockquote"]
    name = r.choice(allowed)
    return (name, r.random() < 0.1, [small_tree(r, depth - 1, name) for _ in range(r.randint(1, 3)) if name not in ("ul", "ol") or depth > 1])


def written(node) -> str:
    return node if isinstance(node, str) else f"<{node[0]}{' hidden' if node[1] else ''}>{''.join(map(written, node[2]))}</{node[0]}>"


def flow(node, indent: int, lists: int) -> list:
    """Events: text, ("break", blank lines), ("indent", n), ("mark", marker)."""
    if isinstance(node, str):
        return [node]
    name, hidden, children = node
    if hidden:
        return []
    if name in ("ul", "ol"):
        blank = 0 if indent else 1
        made, number = [("break", blank)], 1
        for child in children:
            if isinstance(child, str):
                made += [("indent", indent), child]
            elif not child[1]:
                mark = f"{number}. " if name == "ol" else "- "
                number += 1
                made += [("break", 0), ("indent", indent + len(mark)), ("mark", mark)]
                for grandchild in child[2]:
                    made += flow(grandchild, indent + len(mark), lists + 1)
                    made += [("indent", indent + len(mark))]
                made += [("break", 0), ("mark", "")]
        return [*made, ("break", blank), ("indent", indent)]
    deeper = indent + 2 * (name == "blockquote")
    inside = [e for c in children for e in [*flow(c, deeper, lists), ("indent", deeper)]]
    if name not in BLOCKS:
        return inside
    blank = int(name in MARGINS)
    return [("break", blank), ("indent", deeper), *inside, ("break", blank), ("indent", indent)]


def by_events(events: list) -> str:
    lines, now, gap, indent, mark = [], "", 0, 0, ""
    for event in events:
        if isinstance(event, str):
            now += event
            continue
        kind, value = event
        if kind == "break" or (kind == "indent" and value != indent):
            if words := " ".join(now.split()):
                lines += [""] * (max(0, gap - 1) if lines else 0) + [" " * (indent - len(mark)) + mark + words]
                gap, mark = 0, ""
                now = ""
        if kind == "break":
            now, gap = "", max(gap, value + 1)
        elif kind == "indent":
            indent = value
        else:
            mark = value
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(300))
def test_against_a_second_renderer(seed):
    r = random.Random(seed)
    tree = ("div", False, [small_tree(r, 4) for _ in range(3)])
    want = by_events([*flow(tree, 0, 0), ("break", 0)])
    assert re.sub(r"[ ]+$", "", text(written(tree)), flags=re.M) == want, written(tree)


def test_all_visible_text_is_kept():
    words = [f"w{i}" for i in range(200)]
    page = "".join(f"<{t}>{w}" for w, t in zip(words, ["p", "li", "td", "div", "b", "span", "h2", "tr", "dd", "a"] * 20, strict=True))
    got = text(page)
    assert all(w in got for w in words)


def test_pages(spark):
    rows = [(1, "<p>a<p>b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")]
    got = [tuple(r) for r in extract_pages(spark.createDataFrame(rows, "page_id long, html string, title string")).orderBy("page_id").collect()]
    assert got == [(1, "", "a\n\nb", 3), (2, "", "", 0), (3, "", "", 0), (3, "", "", 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
