"""Pages by the roles of their headings, rule by rule, against sections written by hand."""

import pytest

from lodestrata.operators import sections

# (html, [(level, anchor, heading, above, texts)])
PAGES = [
    ("<h2>One</h2><p>a</p><p> b <b>c</b>\nd </p><h3 id='x'>Two</h3><p>e</p>", [(1, None, "One", "One", ["a", "b  c  d"]), (2, "x", "Two", "One", ["e"])]),
    ("<p>before</p><h2 class='role-major-section' id=m>Major</h2><h2 class='visually-hidden'>no</h2><p>kept</p>", [(1, "m", "Major", "Major", ["kept"])]),
    ("<h2>A</h2><h2 class='promo'>banner</h2><p>still A</p>", [(1, None, "A", "A", ["still A"])]),
    ("<h2>A</h2><h2 class='role-taxtable'>Table</h2><p>no</p><h3>no</h3><h4 class='role-hd1'>no</h4><h2>B</h2><p>yes</p>", [(1, None, "A", "A", []), (1, None, "B", "B", ["yes"])]),
    ("<h2>L</h2><h4 class='role-hd1'><a name='l1'></a>Line 1</h4><p>x</p><h4 class='role-hd2'>sub</h4><p>y</p><h4 class='role-hd3'>subsub</h4><p>z</p><h4 class='role-step-section' id='s'>Lines 2 and 3</h4><p>w</p>", [(1, None, "L", "L", []), (3, "l1", "Line 1", "L", ["x", "y", "z"]), (3, "s", "Lines 2 and 3", "L", ["w"])]),
    ("<h2>L</h2><h4 class='role-hd2'>lone</h4><p>to L</p><h4 class='role-intro'>x</h4><p>too</p>", [(1, None, "L", "L", ["to L", "too"])]),
    ("<head><title>t</title><h2>no</h2></head><nav><h2>no</h2><nav><p>no</p></nav></nav><h2>Yes</h2><script>var a='<h2>no</h2>'</script><style>p{}</style><p>in</p><ul><li>dropped</li></ul>bare", [(1, None, "Yes", "Yes", ["in"])]),
    ("<h2></h2><p>lost</p><h3>Kept &amp; well</h3><p>&lt;a&gt;</p>", [(2, None, "Kept & well", "", ["<a>"])]),
    ("<h2>Open<p>inside</p>", []), ("<h2>A</h2><p>lost<p>kept</p>", [(1, None, "A", "A", ["kept"])]),
    ("<h2 id='own'>T<a name='other'>x</a></h2>", [(1, "own", "T x", "T x", [])]),
    (None, []), ("", []), ("no tags at all", []),
]


def test_every_rule_of_the_roles(spark):
    rows = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(PAGES)], "id int, html string, level string")
    got = {}
    for r in sections.sections_by_role(rows, "id", "html").orderBy("id", "sequence").collect():
        assert r["sequence"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append((r["level"], r["anchor"], r["heading"], r["above"], r["texts"]))
    for i, (_, want) in enumerate(PAGES):
        assert got.get(i, []) == want, PAGES[i][0]


@pytest.mark.parametrize(("tag", "classes", "want"), [("h2", "", ("open", 1)), ("h2", "x accordion-title", (None, 0)), ("h3", "anything", ("open", 2)), ("h4", "", (None, 0)), ("h4", "role-hd3", ("merge", 0))])
def test_roles(tag, classes, want):
    assert sections.role(tag, classes) == want
