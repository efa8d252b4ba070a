"""A reader of markup documents: tokens, a stack folded over them, the first break of well-formedness, namespaces.

A document is cut into tokens that cover all of it (comments, sections, instructions, tags, texts; a '<' that begins none of
them is a token of its own). One fold over a document's tokens keeps the stack of open elements with their namespaces;
everything is expressions on the document's own row, so nothing is shuffled. Repeats in the patterns give nothing back
(possessive), so that no document makes a regular expression recurse or retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import first_code

START, REST = r"A-Za-z_:\x{80}-\x{10FFFF}", r"\w:.\-\x{80}-\x{10FFFF}"
NAME = rf"[{START}][{REST}]*"
QUOTED = r"""(?:"[^"]*"|'[^']*')"""
#: Patterns are written without possessive marks, as other engines have none; owned() adds them for this one.
TOKEN = rf"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|</?[{START}][^<>\"']*(?:{QUOTED}[^<>\"']*)*>|<|[^<]+"
OPENS = rf"\A<{NAME}(?:\s+{NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*\s*/?>\z"
CLOSES = rf"\A</{NAME}\s*>\z"
REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);"
UNQUOTED = r"=\s*[^\s\"'=<>]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
ATTRIBUTE = rf"""[^\s=<>"'/]+(?:\s*=\s*(?:{QUOTED}|[^\s"'<>=]+))?"""

SVG_SPACE, LINK_SPACE = "http://www.w3.org/2000/svg", "http://www.w3.org/1999/xlink"


def owned(pattern: str) -> str:
    """The pattern with repeats of classes and groups made possessive; a name is followed by what it can't hold."""
    for repeat in ("]*", "]+", ")*"):
        pattern = pattern.replace(repeat, repeat + "+")
    return pattern


def tokens(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(f"(?s)({owned(TOKEN)})"), F.lit(1))


def kind(token: Column) -> Column:
    """open, close, empty, text, section, comment, instruction or stray."""
    starts = lambda s: F.startswith(token, F.lit(s))
    return (
        F.when(starts("<!--"), "comment").when(starts("<![CDATA["), "section").when(starts("<?"), "instruction").when(token == "<", "stray").when(~starts("<"), "text")
        .when(starts("</"), "close").when(F.endswith(token, F.lit("/>")), "empty").otherwise("open")
    )


def name_of(token: Column) -> Column:
    return F.regexp_extract(token, rf"\A</?({owned(NAME)})", 1)


def attribute_list(token: Column) -> Column:
    """Array of struct(name, value) of an opening tag, however they are spelled: quoted, bare or without a value (null)."""
    inside = F.regexp_replace(F.regexp_replace(token, rf"\A<{owned(NAME)}", ""), r"/?>\z", "")
    each = F.regexp_extract_all(inside, F.lit(f"(?s)({owned(ATTRIBUTE)})"), F.lit(1))

    def parts(a):
        value = F.regexp_extract(a, r"(?s)\A[^=]*=\s*(.*)\z", 1)
        quoted = value.rlike(r"(?s)\A[\"']")
        return F.struct(F.regexp_extract(a, r"\A([^\s=]+)", 1).alias("name"), F.when(F.contains(a, F.lit("=")), F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)).alias("value"))

    return F.transform(each, parts)


def decoded(value: Column) -> Column:
    """Character references replaced, each once; what is no reference stays."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)(&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});|[^&]++|&)"), F.lit(1))
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(p):
        code = F.when(F.startswith(p, F.lit("&#x")), F.conv(F.regexp_extract(p, "x([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(p, "#([0-9]+)", 1)).try_cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.when(F.startswith(p, F.lit("&#")) & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        known = F.lit(None).cast("string")
        for reference, character in named.items():
            known = F.when(p == reference, character).otherwise(known)
        return F.coalesce(number, known, p)

    return F.array_join(F.transform(parts, one), "")


def bad_reference(text: Column) -> Column:
    return F.contains(F.regexp_replace(text, REFERENCE, ""), F.lit("&"))


def lexical(token: Column, what: Column) -> Column:
    """What a token breaks by itself, or null."""
    opens = what.isin("open", "empty")
    names = F.transform(attribute_list(token), lambda a: a["name"])
    return first_code(
        ("stray-less-than", what == "stray"),
        ("bad-comment", (what == "comment") & F.contains(F.substr(token, F.lit(5), F.length(token) - 7), F.lit("--"))),
        ("bad-closing-tag", (what == "close") & ~token.rlike(owned(CLOSES))),
        ("unquoted-attribute", opens & F.regexp_replace(token, QUOTED, '""').rlike(UNQUOTED)),
        ("bad-tag", opens & ~token.rlike("(?s)" + owned(OPENS))),
        ("duplicate-attribute", opens & (F.size(names) > F.size(F.array_distinct(names)))),
        ("bad-reference", (opens | (what == "text")) & bad_reference(token)),
        ("bad-text", ((what == "text") & F.contains(token, F.lit("]]>"))) | token.rlike(CONTROL)),
    )


STACK = "struct<name:string,space:string,prefixes:map<string,string>>"


def read(markup: Column) -> Column:
    """struct(tokens, elements, depth, code, at, root, root_space, foreign): one fold over a document's tokens.

    code and at are of the first break (at counts tokens; an end that comes too early is at their number), null in a
    well-formed document. root and root_space are the first element's local name and namespace; foreign counts elements of
    other namespaces than SVG's. Prefixes that nothing declares have the namespace null. After a break a closing tag still
    takes the last open element off, so depth and foreign stay defined.
    """
    made = F.transform(tokens(markup), lambda t: F.struct(t.alias("t"), kind(t).alias("k")))
    made = F.transform(made, lambda s: F.struct(s["k"].alias("k"), F.when(s["k"].isin("open", "close", "empty"), name_of(s["t"])).alias("n"), F.when(s["k"].isin("open", "empty"), attribute_list(s["t"])).alias("a"), lexical(s["t"], s["k"]).alias("c"), ((s["k"] == "section") | ((s["k"] == "text") & (F.regexp_replace(s["t"], r"[ \t\r\n]", "") != ""))).alias("w")))
    start = F.struct(
        F.lit(0).alias("i"), F.array().cast(f"array<{STACK}>").alias("stack"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("elements"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("root_space"), F.lit(0).alias("foreign"),
    )

    def step(s, t):
        opens, level = t["k"].isin("open", "empty"), F.size(s["stack"])
        top = F.get(s["stack"], level - 1)
        spaces = F.filter(t["a"], lambda a: a["name"] == "xmlns")
        declared = F.filter(F.coalesce(t["a"], F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.startswith(a["name"], F.lit("xmlns:")))
        own = F.map_from_entries(F.transform(_first_of_each(declared), lambda a: F.struct(F.substr(a["name"], F.lit(7)), a["value"])))
        before = F.coalesce(top["prefixes"], F.create_map().cast("map<string,string>"))
        prefixes = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(own, k)), own)
        default = F.coalesce(F.get(spaces, F.lit(0))["value"], top["space"], F.lit(""))
        prefix = F.when(F.contains(t["n"], F.lit(":")), F.substring_index(t["n"], ":", 1))
        space = F.when(prefix.isNull(), default).otherwise(F.try_element_at(prefixes, prefix))
        is_svg = F.coalesce(space == SVG_SPACE, F.lit(False))
        broken = F.coalesce(t["c"], first_code(
            ("stray-close", (t["k"] == "close") & (level == 0)), ("misnested", (t["k"] == "close") & (top["name"] != t["n"])),
            ("several-roots", opens & (level == 0) & (s["elements"] > 0)), ("content-outside-root", t["w"] & (level == 0)),
        ))
        pushed = F.when(t["k"] == "open", F.concat(s["stack"], F.array(F.struct(t["n"].alias("name"), default.alias("space"), prefixes.alias("prefixes"))))).when((t["k"] == "close") & (level > 0), F.slice(s["stack"], F.lit(1), level - 1)).otherwise(s["stack"])
        first = opens & (s["elements"] == 0)
        return F.struct(
            (s["i"] + 1).alias("i"), pushed.alias("stack"), F.coalesce(s["code"], broken).alias("code"), F.when(s["code"].isNotNull(), s["at"]).when(broken.isNotNull(), s["i"]).alias("at"),
            (s["elements"] + F.when(opens, 1).otherwise(0)).alias("elements"), F.greatest(s["depth"], level + F.when(opens, 1).otherwise(0)).alias("depth"),
            F.when(first, F.substring_index(t["n"], ":", -1)).otherwise(s["root"]).alias("root"), F.when(first, space).otherwise(s["root_space"]).alias("root_space"), (s["foreign"] + F.when(opens & ~is_svg, 1).otherwise(0)).alias("foreign"),
        )

    def finish(s):
        late = first_code(("no-root", s["elements"] == 0), ("unclosed", F.size(s["stack"]) > 0))
        return F.struct(
            s["i"].alias("tokens"), s["elements"].alias("elements"), s["depth"].alias("depth"), F.coalesce(s["code"], late).alias("code"), F.when(s["code"].isNotNull(), s["at"]).when(late.isNotNull(), s["i"]).alias("at"),
            s["root"].alias("root"), s["root_space"].alias("root_space"), s["foreign"].alias("foreign"),
        )

    return F.aggregate(made, start, step, finish)


def _first_of_each(attributes: Column) -> Column:
    """Of attributes of one name the first: a repeated one is a break of its own, and a map must not see it twice."""
    return F.aggregate(attributes, F.array().cast("array<struct<name:string,value:string>>"), lambda kept, a: F.when(F.exists(kept, lambda k: k["name"] == a["name"]), kept).otherwise(F.concat(kept, F.array(a))))


def document_codes(document: Column) -> Column:
    """What a read document breaks as a whole: not-well-formed alone, else its root's and its elements' namespaces."""
    wrong_root = ~(F.coalesce(document["root"] == "svg", F.lit(False)) & F.coalesce(document["root_space"] == SVG_SPACE, F.lit(False)))
    return F.when(document["code"].isNotNull(), F.array(F.lit("not-well-formed"))).otherwise(F.array_compact(F.array(F.when(wrong_root, "invalid-svg-root"), F.when(document["foreign"] > 0, "foreign-namespace"))))


def breaks(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, tokens, elements, depth, code and at of each document; a null document is an empty one."""
    document = F.explode(F.array(read(F.coalesce(F.col(markup), F.lit(""))))).alias("document")  # read once, whatever is taken of it
    return df.select(key, document).select(key, "document.tokens", "document.elements", "document.depth", "document.code", "document.at")
