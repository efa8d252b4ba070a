"""The markup reader against a plain loop with a stack and against the standard library's parser."""

import random
import re
from xml.parsers import expat

from pyspark.sql import functions as F

from panelspark.operators import markup, markup_reader

NAME = r"[A-Za-z_:][\w:.\-]*"
CUT = re.compile(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|</?[A-Za-z_:][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>|<|[^<]+")
REFERENCE = re.compile(r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);")


def own_break(t):
    if t == "<":
        return "stray-less-than"
    if t.startswith("<!--"):
        return "bad-comment" if "--" in t[4:-3] else None
    if t.startswith(("<![CDATA[", "<?")):
        return None
    if t.startswith("</"):
        return None if re.fullmatch(rf"</{NAME}\s*>", t) else "bad-closing-tag"
    if t.startswith("<"):
        if re.search(r"=\s*[^\s\"'=<>]", re.sub(r"\"[^\"]*\"|'[^']*'", '""', t)):
            return "unquoted-attribute"
        if not re.fullmatch(rf"(?s)<{NAME}(?:\s+{NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*\s*/?>", t):
            return "bad-tag"
        names = re.findall(rf"({NAME})\s*=", re.sub(r"\"[^\"]*\"|'[^']*'", "", t))
        if len(names) > len(set(names)):
            return "duplicate-attribute"
    elif "]]>" in t and "&" not in REFERENCE.sub("", t):
        return "bad-text"
    return "bad-reference" if "&" in REFERENCE.sub("", t) else None


def by_hand(text):
    """tokens, elements, code, at."""
    cut = CUT.findall(text)
    assert "".join(cut) == text
    stack, elements, broken = [], 0, None
    for i, t in enumerate(cut):
        code = own_break(t)
        is_tag = re.match(rf"</?{NAME}", t)
        if t.startswith("</") and is_tag:
            name = re.match(rf"</({NAME})", t)[1]
            if not stack:
                code = code or "stray-close"
            elif stack.pop() != name:
                code = code or "misnested"
        elif is_tag:
            if not stack and elements:
                code = code or "several-roots"
            elements += 1
            if not t.endswith("/>"):
                stack.append(re.match(rf"<({NAME})", t)[1])
        elif not stack and (t.startswith("<![CDATA[") or (not t.startswith("<") and t.strip(" \t\r\n"))):
            code = code or "content-outside-root"
        if code and not broken:
            broken = code, i
    late = "no-root" if not elements else "unclosed" if stack else None
    return (len(cut), elements, *(broken or ((late, len(cut)) if late else (None, None))))


def random_document(rng, depth=0):
    name = rng.choice(["svg", "g", "path", "a:b"])
    attributes = "".join(f' {n}="{rng.choice(["1", "&amp;", "x y", "&#65;"])}"' for n in rng.sample(["id", "x", "y", "d"], rng.randint(0, 3)))
    if depth > 3 or rng.random() < 0.2:
        return f"<{name}{attributes}/>"
    inner = "".join(rng.choice([" ", "t&lt;", "<!-- c -->", "<![CDATA[<x>]]>", ""]) + random_document(rng, depth + 1) for _ in range(rng.randint(0, 3)))
    return f"<{name}{attributes}>{inner}</{name}>"


def damaged(rng, text):
    at = rng.randrange(len(text) + 1)
    return rng.choice([
        lambda: text[:at] + text[at + 1 :], lambda: text[:at] + rng.choice("<>&\"'/= x") + text[at:], lambda: text[:at], lambda: text.replace('"', "", 2), lambda: text + text, lambda: text.replace("</g>", "", 1),
        lambda: re.sub(r"<(\w+) ", r'<\1 q="1" q="2" ', text, count=1), lambda: text.replace("</g>", "</path>", 1), lambda: text.replace("<!-- c -->", "<!-- c -- d -->", 1), lambda: " tail " + text, lambda: text,
    ])()


def accepted(text):
    try:
        expat.ParserCreate().Parse(text, True)
    except expat.ExpatError:
        return False
    return True


def test_reader_against_a_loop_and_a_parser(spark):
    rng = random.Random(7)
    texts = ["", " ", "x", "<svg", "<svg>", "</svg>", "<svg/>", "<svg></g>", "<svg/><svg/>", "<svg a=1/>", "<svg a/>", '<svg a="1" a="2"/>', "<svg>]]></svg>", "<svg><!-- a -- b --></svg>", "<svg>&nbsp;</svg>", "<svg/>tail", "<1/>"]
    for _ in range(500):
        text = random_document(rng)
        for _ in range(rng.randint(0, 2)):
            text = damaged(rng, text)
        texts.append(text)
    got = markup_reader.breaks(spark.createDataFrame(list(enumerate(texts)), "id int, m string"), "id", "m").collect()
    wrong = [(texts[r.id], (r.tokens, r.elements, r.code, r.at), by_hand(texts[r.id])) for r in got if (r.tokens, r.elements, r.code, r.at) != by_hand(texts[r.id])]
    assert not wrong, wrong[:3]
    differ = [(texts[r.id], r.code) for r in got if (r.code is None) != accepted(texts[r.id])]
    assert not differ, differ[:3]
    assert sum(r.code is None for r in got) > 100 and len({r.code for r in got}) > 9


def test_large_tags_and_null_documents(spark):
    many = "<svg " + " ".join(f'a{i}="{i}"' for i in range(20_000)) + "/>"
    rows = [(1, many), (2, None), (3, "<g>" * 3000 + "</g>" * 3000), (4, "<svg " + "\"" * 9999 + ">")]
    got = {r.id: (r.elements, r.depth, r.code) for r in markup_reader.breaks(spark.createDataFrame(rows, "id int, m string"), "id", "m").collect()}
    assert got == {1: (1, 1, None), 2: (0, 0, "no-root"), 3: (3000, 3000, None), 4: (0, 0, "stray-less-than")}


def test_namespaces(spark):
    svg, link = markup_reader.SVG_SPACE, markup_reader.LINK_SPACE
    rows = {
        1: (f'<svg xmlns="{svg}"><g/></svg>', []), 2: ("<svg/>", ["invalid-svg-root", "foreign-namespace"]), 3: (f'<s:svg xmlns:s="{svg}"><s:g/></s:svg>', []),
        4: (f'<svg xmlns="{svg}"><g xmlns="{link}"><p/></g><g/></svg>', ["foreign-namespace"]), 5: (f'<html xmlns="{svg}"/>', ["invalid-svg-root"]), 6: (f'<svg xmlns="{svg}"><q:g/></svg>', ["foreign-namespace"]),
        7: (f'<svg xmlns="{svg}"><g></svg>', ["not-well-formed"]), 8: (f'<svg xmlns="{svg}"><a xmlns:p="{svg}"><p:g/></a><p:g/></svg>', ["foreign-namespace"]),
    }
    df = spark.createDataFrame([(i, m) for i, (m, _) in rows.items()], "id int, m string")
    got = {r.id: r.codes for r in df.select("id", markup_reader.document_codes(markup_reader.read(F.col("m"))).alias("codes")).collect()}
    assert got == {i: codes for i, (_, codes) in rows.items()}


def test_attributes_however_spelled_and_decoded(spark):
    tag = """<a x="1" y='2 > 1' z=3/4 on disabled ="q" w = bare>"""
    got = spark.createDataFrame([(tag,)], "t string").select(markup_reader.attribute_list(F.col("t"))).first()[0]
    assert [tuple(a) for a in got] == [("x", "1"), ("y", "2 > 1"), ("z", "3/4"), ("on", None), ("disabled", "q"), ("w", "bare")]
    values = ["&#106;ava", "&#x6A;", "&amp;lt;", "&lt;&gt;&quot;&apos;", "&#x1F600;", "&nope;&", "&#0;&#xD800;", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(markup_reader.decoded(F.col("v"))).collect()]
    assert got == ["java", "j", "&lt;", "<>\"'", "😀", "&nope;&", "&#0;&#xD800;", ""]


SVG = f'<svg xmlns="{markup_reader.SVG_SPACE}" viewBox="0 0 24 24">'


def test_issues_see_every_spelling(spark):
    rows = {
        1: (SVG + "<g onclick=alert(1)></g></svg>", {"not-well-formed", "unsafe-event-attribute"}), 2: (SVG + "<use href=http://x/y></use></svg>", {"not-well-formed", "external-resource"}),
        3: (SVG + "<g><path></g></path></svg>", {"not-well-formed"}), 4: (SVG + "<g>", {"not-well-formed"}), 5: (SVG + '<g id="a" id="b"/></svg>', {"not-well-formed"}), 6: (SVG + "<g/></svg>", set()),
        7: (SVG + '<path fill="url&#40;http://x&#41;"/></svg>', {"external-resource"}), 8: (SVG + '<use href="&#35;ok"/></svg>', set()), 9: (SVG + "<g onload/></svg>", {"not-well-formed", "unsafe-event-attribute"}),
        10: (SVG + "<g/></svg>" + SVG + "</svg>", {"not-well-formed"}), 11: ("", {"not-well-formed"}), 12: (SVG.replace("viewBox", "viewbox") + "</svg>", {"unsupported-attribute", "invalid-viewbox"}),
    }
    found = {i: set() for i in rows}
    for r in markup.issues(spark.createDataFrame([(i, m) for i, (m, _) in rows.items()], "id int, m string"), "id", "m").collect():
        found[r.id].add(r.code)
    assert found == {i: codes for i, (_, codes) in rows.items()}
