import pytest

from sievelight.llm.html_text import extract_html, page_title, visible_text

CASES = {
    "implied paragraphs": ("<p>One<p>two <b>bold</b>ly<br>new", "One\n\ntwo boldly\nnew"),
    "implied list items": ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    "implied cells": ("<table><tr><th>Name<th>Value<tr><td>long cell<td>1</table>after", "Name      | Value\nlong cell | 1\n\nafter"),
    "table parts": ("<table><caption>c</caption><thead><tr><td>a<tbody><tr><td>b</table>", "c\na\nb"),
    "nested table": ("<table><tr><td><table><tr><td>in<td>side</table><td>x</table>", "in | side | x"),
    "hidden": ("<div style='color:red; display : none'>no</div><p hidden>no<p style=visibility:hidden>no</p>yes", "yes"),
    "head matter": ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>b</body></html>", "b"),
    "body without head end": ("<head><title>t</title><p>text", "text"),
    "noscript and template": ("a<noscript>x</noscript><template>y</template>b", "ab"),
    "entities": ("&copy; &amp;lt; &#233; &nbsp;x", "© &lt; é \xa0x"),
    "comments": ("a<!-- <p>no -->b<!DOCTYPE x><!-- open", "ab"),
    "pre": ("x<pre>\n  a\n\n   b </pre>y", "x\n\n  a\n\n   b\n\ny"),
    "quote": ("<blockquote>a<p>b</blockquote>", "> a\n>\n> b"),
    "terms": ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n    v\nl\n    w"),
    "attributes with signs": ("<a title='a > b' href=\"x>y\">link</a> 5 < 6", "link 5 < 6"),
    "stray ends": ("</div></b>a</p>b", "a\n\nb"),
    "self closing div": ("<div/>a<div>b", "a\nb"),
    "spaces": ("  a \n\t b  <i> c</i> d ", "a b c d"),
    "block spacing": ("<div>a</div><div>b</div><h1>c</h1>d", "a\nb\n\nc\n\nd"),
    "textarea": ("<textarea>a &lt; <b></textarea>z", "a < <b>\nz"),
    "input": ("<input type=hidden value=x>a<img alt=y>b", "ab"),
    "empty": ("", ""),
    "only tags": ("<p><div></div>", ""),
    "broken": ("<<a <b attr='>x<", None),
    "deep": ("<div>" * 5000 + "x", "x"),
    "hidden below many": ("<div>" * 3000 + "<p hidden>no<p style='display:none'>no</p>yes", "yes"),
    "ends below many": ("<b>" * 1000 + "<ul><li>a" + "<i>" * 500 + "b<li>c</ul>" + "</b>" * 1000 + "d", "- ab\n- c\n\nd"),
    "columns": ("<table><tr><th colspan=2>Wide head<th>C<tr><td>a<td>bb<td>c</table>", "Wide head | C\na | bb    | c"),
    "wide cell": ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>longer than both<td>d</table>", "a | b            | c\nlonger than both | d"),
    "rows": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    "odd spans": ("<table><tr><td colspan=0>a<td colspan=x>b<td colspan=99999>c<tr><td>d</table>", "a | b | c\nd"),
    "drawings": ("<svg><title>no</title><text>drawn</text><desc>no</desc></svg> <math><mi>x</mi><annotation>no</annotation></math>", "drawn x"),
    "example": ("a<xmp><b> &amp;\n c</xmp>d", "a\n\n<b> &amp;\n c\n\nd"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    page, expected = CASES[name]
    got = visible_text(page)
    assert got == expected if expected is not None else isinstance(got, str)


def test_title():
    assert page_title("<TITLE lang=en> a\n &amp; b </TITLE>") == "a & b"
    assert page_title("x") is None and page_title(None) is None
    assert page_title("<!-- <title>no</title> --><script>'<title>no</title>'</script><svg><title>no</title></svg><title>yes</title><title>second</title>") == "yes"


def test_table(spark):
    rows = [(1, "<p>a", "old", "t"), (1, "<p>a", "old", "t"), (2, None, None, None), (3, "", "", "")]
    df = spark.createDataFrame(rows, "page_id int, html string, extracted_text string, TITLE string")
    out = extract_html(df)
    assert out.columns == ["page_id", "html", "input_extracted_text", "input_TITLE", "extracted_text", "title"]
    got = sorted(((r["page_id"], r["extracted_text"]) for r in out.collect()), key=str)
    assert got == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert extract_html(df.limit(0)).count() == 0


class Reference:
    """A slow renderer of well-formed trees: marks of lines and gaps first, text last."""

    def __init__(self, rng):
        self.rng, self.words = rng, 0

    def word(self):
        self.words += 1
        return f"w{self.words}"

    def tree(self, depth):
        r = self.rng
        kind = r.choice(["text", "div", "p", "ul", "ol", "table", "quote", "hidden", "span"] if depth > 0 else ["text", "p"])
        if kind in ("text", "p"):
            return kind, [self.word() for _ in range(r.randint(1, 3))]
        if kind in ("ul", "ol"):
            return kind, [[self.tree(depth - 1) for _ in range(r.randint(1, 2))] for _ in range(r.randint(1, 3))]
        if kind == "table":
            n = r.randint(1, 3)
            return kind, [[[self.word() for _ in range(r.randint(0, 2))] for _ in range(n)] for _ in range(r.randint(1, 3))]
        return kind, [self.tree(depth - 1) for _ in range(r.randint(1, 3))]

    def markup(self, node):
        """HTML with end tags left out where the next tag implies them."""
        kind, x = node
        inner = lambda: "".join(map(self.markup, x))
        if kind == "text":
            return " " + self.rng.choice([" ", "\n\t"]).join(x) + " "
        if kind == "p":
            return "<p>" + " <b>".join(x) + "</b>" * (len(x) - 1) + "</p>"
        if kind in ("ul", "ol"):
            items = "".join("<LI>" + "".join(map(self.markup, i)) + self.rng.choice(["", "</li>"]) for i in x)
            return f"<{kind}>{items}</{kind}>"
        if kind == "table":
            rows = "".join(f"<tr>{''.join('<td>' + ' '.join(c) + self.rng.choice(['', '</td>']) for c in row)}{self.rng.choice(['', '</tr>'])}" for row in x)
            return f"<table>{self.rng.choice(['', '<tbody>'])}{rows}</table>"
        if kind == "span":
            return f"<span>{inner()}</span>"
        return {"div": f"<div>{inner()}</div>", "quote": f"<blockquote>{inner()}</blockquote>", "hidden": f"<div hidden>{inner()}</div>"}[kind]

    def marks(self, node, parent):
        """A list of words, line ends, gaps (blank line), and whole lines."""
        kind, x = node
        if kind == "text":
            return [("word", w) for w in x]
        if kind == "hidden":
            return []
        if kind == "span":
            return [m for y in x for m in self.marks(y, parent)]
        if kind == "p":
            return ["gap", *(("word", w) for w in x), "gap"]
        if kind == "div":
            return ["end", *(m for y in x for m in self.marks(y, parent)), "end"]
        if kind == "quote":
            return ["gap", *(("line", "> " + s if s else ">") for s in self.lines(x, parent)), "gap"]
        if kind == "table":
            rows = [[" ".join(c) for c in row] for row in x]
            widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
            lines = [" | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in rows]
            return ["gap", *(("line", s) for s in lines if s.strip(" |")), "gap"]
        edge = "end" if parent == "li" else "gap"
        out = [edge]
        for k, item in enumerate(x):
            mark = f"{k + 1}. " if kind == "ol" else "- "
            out += [("line", (mark if i == 0 else " " * len(mark)) + s if s else "") for i, s in enumerate(self.lines(item, "li"))]
            out.append("end")
        return [*out, edge]

    def lines(self, nodes, parent):
        out, line, gap = [], [], False
        for m in [*(m for n in nodes for m in self.marks(n, parent)), "end"]:
            if m in ("end", "gap") or m[0] == "line":
                if line:
                    out += ([""] if gap and out else []) + [" ".join(line)]
                    line, gap = [], False
                if m == "gap":
                    gap = True
                elif m[0] == "line":
                    out += ([""] if gap and out else []) + [m[1]]
                    gap = False
            else:
                line.append(m[1])
        return out


@pytest.mark.parametrize("seed", range(60))
def test_equals_a_slow_renderer(seed):
    import random

    slow = Reference(random.Random(seed))
    nodes = [slow.tree(3) for _ in range(4)]
    page = "".join(map(slow.markup, nodes))
    assert visible_text(page) == "\n".join(slow.lines(nodes, "body")), page


def test_cost_does_not_grow_with_depth():
    import time

    began = time.perf_counter()
    for page in ("<b>" * 100_000 + "x", "<p>x<div>" * 50_000, "<b><table>" + "<div>" * 50_000 + "</b>" * 50_000, "</x>" * 100_000, "<ul><li>" * 2000 + "x"):
        visible_text(page)
    assert time.perf_counter() - began < 60
