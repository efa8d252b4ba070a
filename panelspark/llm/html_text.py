"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

Pages of a host are told apart by their skeleton (outer containers, and whether one marks an article), and each becomes a
stream of tokens: the path of elements of a run of blocks and the texts in it. The wrapper of a skeleton starts as one page's
stream and is aligned with the next ones: texts that both sides have in a slot stay as its fixed texts and others make it
vary, a mismatch of tags is a repeated group where the same block, however long, stands next to itself on either side, else an
optional group. Wrappers are merged the same way, so inference runs over the distinct streams of a skeleton, partial wrappers
first, and no host's pages are gathered. Then each slot of a wrapper is decided once, from what all its pages have there:
marks (article, main; boilerplate by element, class or role) name slots; where no article is marked, slots that hold mostly
links are out and fixed texts that three or more different pages share are template. A page is matched against its wrapper
and its text is what lies in the article's slots. Pages of a host with fewer than three have no template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

# Element kinds of HTML, by what they mean for text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video", "title", "xmp")
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"}
MAIN = {"article", "main"}
BOILER = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar\w*|side|aside|widget\w*|ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|search\w*|comments?|commentlist|respond|disqus\w*|replies|reply|share\w*|social|related|recommend\w*|pagination|pager|copyright|legal|toolbar|skip\w*|hidden)(?=$|[\s_-])", re.I
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}

ABSENT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without)[_-]\S+", re.I)  # names of what a part lacks or surrounds
WHOLE = {"html", "body", *MAIN}  # class marks don't make these boilerplate

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTR = re.compile(r"([a-zA-Z_:][^\s=/>]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
RAW_END = {r: re.compile(rf"</{r}\s*>?", re.I) for r in RAW}
SPACE = re.compile(r"\s+")
#: Elements that a start tag of the given kind closes when they stand open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


def label_of(name: str, raw: str) -> tuple[str, bool]:
    """A tag as the alignment compares it, and whether its attributes call it boilerplate."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return name, False
    got = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(raw)}
    mark = "" if name in WHOLE else ABSENT.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(x for x in (got.get("class", ""), got.get("id", "")) if x)))
    bad = "hidden" in got or got.get("aria-hidden", "") == "true" or got.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""))) or bool(mark and BOILER.search(mark))
    first = got.get("class", "").split()
    return (f"{name}.{first[0]}" if first else name), bad


def events(page: str):
    """(kind, value) of a page: ('<', label, boilerplate, name), ('>', name) and ('t', text); entities are still encoded."""
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            yield "t", page[at:], False, ""
            return
        if m.start() > at:
            yield "t", page[at : m.start()], False, ""
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "t", entities.escape(m[0][9:-3], quote=False), False, ""
            continue
        name = m[2].lower()
        if m[1]:
            yield ">", name, False, name
            continue
        if name in RAW_END:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        label, bad = label_of(name, m[3])
        yield "<", label, bad, name


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(path, text, share of link text) of every block of text, in page order.

    The path names the open block elements; it starts with '!' inside boilerplate. Inline elements don't break a block.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str, bool]] = []  # name, label, boilerplate
    parts: list[str] = []
    linked = [0, 0]
    links = 0

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            path = "/".join(x[1] for x in stack if x[0] not in INLINE)
            out.append((("!" if any(x[2] for x in stack) else "") + path, text, linked[0] / max(1, linked[1])))
        parts.clear()
        linked[0] = linked[1] = 0

    for kind, value, bad, name in events(page):
        if kind == "t":
            parts.append(value)
            linked[1] += len(value)
            if links:
                linked[0] += len(value)
        elif kind == "<":
            inline = name in INLINE
            if name == "br":
                parts.append(" ")
                continue
            if not inline:
                flush()
                shut = CLOSES.get(name, set()) | ({"p"} if name in P_ENDERS else set())
                if shut:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in shut:
                            links -= sum(x[0] == "a" for x in stack[i:])
                            del stack[i:]
                            break
                        if stack[i][0] not in INLINE and stack[i][0] not in shut and stack[i][0] not in ("thead", "tbody", "tfoot"):
                            break
            if name not in VOID:
                stack.append((name, value, bad or name in ASIDE))
                links += name == "a"
        else:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    links -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break  # a stray end tag
    flush()
    return out


# --- wrappers: tokens (optional, path, repeated, fixed texts, three of the pages, characters and those of links) -----------

LEAST_PAGES = 3
#: How many cells of an alignment are kept for its trace; larger ones are halved first.
TRACE_BITS = 1 << 25


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def own_of(found: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    return [x for x in found if not x[0].startswith("!")]


def in_main(path: str) -> bool:
    """Whether a path passes an element that marks an article, outside of boilerplate."""
    return not path.startswith("!") and any(y.split(".")[0] in MAIN for y in path.split("/"))


def skeleton(found: list[tuple[str, str, float]]) -> str:
    """Outer containers of a page's own blocks, and whether it marks an article."""
    paths = {p for p, _, _ in own_of(found)}
    return digest("\n".join(sorted({"/".join(p.split("/")[:3]) for p in paths} | {f"marked {any(map(in_main, paths))}"})))


def runs(found: list[tuple[str, str, float]]) -> list[list[int]]:
    """Positions of neighbouring blocks with one path."""
    out: list[list[int]] = []
    for i, (path, _, _) in enumerate(found):
        if out and found[out[-1][0]][0] == path:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def repeats(paths: list[str]) -> list[list[int]]:
    """Slots as positions: a block of paths of any length that stands next to itself becomes one, smallest blocks first."""
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(p, len(names)) for p in paths], np.int64)
    slots = [[i] for i in range(len(paths))]
    size = 1
    while len(names) < len(slots) and size <= len(slots) // 2:
        same = np.concatenate(([False], ids[:-size] == ids[size:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        found, upto = [], 0
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            start = max(start, upto)
            times = (end - start) // size
            if times > 0:
                found.append((start, times))
                upto = start + (times + 1) * size
        if not found:
            size += 1
            continue
        left = np.ones(len(slots), bool)
        for start, times in found:
            for k in range(size):
                slots[start + k] = [x for t in range(times + 1) for x in slots[start + t * size + k]]
            left[start + size : start + (times + 1) * size] = False
        slots = [x for x, y in zip(slots, left.tolist(), strict=True) if y]
        ids = ids[left]
    return slots


def stream(found: list[tuple[str, str, float]]) -> tuple:
    """The slots of a page by path; texts of slots that marks don't name yet are kept as hashes."""
    plain = not any(in_main(p) for p, _, _ in found)
    page = digest("\n".join(t for _, t, _ in own_of(found))) if plain else ""
    out = []
    for run in runs(found):
        path = found[run[0]][0]
        open_slot = plain and not path.startswith("!")
        chars = [(len(found[i][1]), found[i][2]) for i in run] if open_slot else []
        fixed = " ".join(sorted({digest(found[i][1]) for i in run})) if open_slot else ""
        out.append(("", path, "+" if len(run) > 1 else "", fixed, page, f"{sum(n for n, _ in chars)} {round(sum(n * x for n, x in chars))}"))
    return tuple(out)


def _any(a: str, b: str) -> str:
    return " ".join(sorted({*a.split(), *b.split()}))


def _both(a: tuple, b: tuple) -> tuple:
    """Texts, pages and characters of a slot of two sides: what is fixed in either, some of the pages of both, sums."""
    if len(a) == 3:
        return ()
    chars = " ".join(str(int(x) + int(y)) for x, y in zip(a[5].split(), b[5].split(), strict=True))
    return " ".join(sorted(set(a[3].split()) & set(b[3].split()))), " ".join(_any(a[4], b[4]).split()[:LEAST_PAGES]), chars


def _beside(a: tuple, b: tuple) -> tuple:
    """The same for two slots of one side that become one: a page that has a slot that isn't optional has its fixed texts."""
    if len(a) == 3:
        return ()
    fixed, pages, chars = _both(a, b)
    if a[0] != "?":
        fixed = _any(fixed, a[3])
    if b[0] != "?":
        fixed = _any(fixed, b[3])
    return fixed, pages, chars


def fold(tokens: list[tuple]) -> list[tuple]:
    """Repeated groups: a block of tokens that stands next to itself becomes one, its slots marked as repeated."""
    out = []
    for slot in repeats([t[1] for t in tokens]):
        got = tokens[slot[0]]
        for i in slot[1:]:
            x = tokens[i]
            got = ("?" if got[0] == x[0] == "?" else "", got[1], "+", *_beside(got, x))
        out.append(got)
    return out


def _rows(a: list[str], b: list[str]):
    """For each beginning of a: a number whose zero bits tell where the longest common subsequence with b grows."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    full = row = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for x in a:
        if x in places:
            if x not in masks:
                if (len(masks) + 1) * len(b) > TRACE_BITS:
                    masks.clear()
                bits = bytearray(len(b) // 8 + 1)
                for j in places[x]:
                    bits[j >> 3] |= 1 << (j & 7)
                masks[x] = int.from_bytes(bits, "little")
            hit = row & masks[x]
            row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a with each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _inner(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TRACE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _inner(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _inner(a[half:], b[cut:])]
    kept = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if kept[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or kept[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in memory that grows with the lengths and not with their product."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _inner(a[head : len(a) - tail], b[head : len(b) - tail])
    return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: tuple, b: tuple) -> tuple:
    """The least union-free expression of either that takes both: tokens of one side only are optional."""
    out, i, j = [], 0, 0
    for x, y in [*common([t[1] for t in a], [t[1] for t in b]), (len(a), len(b))]:
        out += [("?", *t[1:]) for t in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append((a[x][0] or b[y][0], a[x][1], a[x][2] or b[y][2], *_both(a[x], b[y])))
        i, j = x + 1, y + 1
    return tuple(fold(out))


def joined(wrappers: list[tuple]) -> tuple:
    """One wrapper of several, each aligned with what the ones before it gave."""
    got = wrappers[0]
    for w in wrappers[1:]:
        got = align(got, w)
    return got


def written(wrapper: tuple) -> str:
    return "\n".join("\t".join(t) for t in wrapper)


def read(text: str) -> tuple:
    return tuple(tuple(x.split("\t")) for x in text.split("\n")) if text else ()


def decided(wrapper: tuple) -> list[tuple[str, str, str]]:
    """(kind, path, fixed texts) of each slot: a where texts are the article's, t where all but the fixed ones are, - elsewhere.

    Boilerplate is out. Marks name the article's slots if the wrapper has any; without them a slot is text unless most
    characters that its pages have there are links, and texts that its pages have in common are template.
    """
    named = any(in_main(t[1]) for t in wrapper)
    out = []
    for _, path, _, fixed, pages, chars in wrapper:
        n, linked = map(int, chars.split())
        if named or path.startswith("!"):
            out.append(("a" if in_main(path) else "-", path, ""))
        else:
            out.append(("t" if linked <= 0.5 * n else "-", path, fixed if len(pages.split()) >= LEAST_PAGES else ""))
    return out


def matched(paths: list[str], wrapper: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The wrapper's slot for each run of a page: its folded stream is aligned with the wrapper.

    A slot that the alignment leaves out, as where repeated groups lie across each other, takes the first one with its path.
    """
    slots = repeats(paths)
    at = dict(common([paths[s[0]] for s in slots], [w[1] for w in wrapper]))
    first: dict[str, tuple[str, str, str]] = {}
    for w in wrapper:
        first.setdefault(w[1], w)
    out = [("-", "", "")] * len(paths)
    for k, slot in enumerate(slots):
        for i in slot:
            out[i] = wrapper[at[k]] if k in at else first.get(paths[i], out[i])
    return out


def host_of(url):
    """The host of a url, lower-cased; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = 32 << 20) -> DataFrame:
    """id, url, text and n_chars (code points) of each page.

    Null and empty pages have the empty text. Pages without a host share the empty host, where skeletons tell
    templates apart. Repeated rows come
    back each; ids and urls may be null; other columns are left out. The wrappers' fixed texts are broadcast while they measure
    less than max_broadcast bytes in all, and joined by host beyond it.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    kind = pages.schema[id_col].dataType.simpleString()

    def survey(source):
        """A wrapper a host and skeleton, as far as a task's table of distinct streams goes."""
        table: dict[tuple, tuple] = {}
        size = 0

        def out():
            by: dict[tuple, list] = {}
            for (h, k, shape), w in table.items():
                by.setdefault((h, k), []).append((len(shape), shape, w))
            rows = [(h, k, written(joined([x[2] for x in sorted(v)]))) for (h, k), v in by.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["host", "skeleton", "wrapper"])

        for batch in source:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page)
                if not own_of(found):
                    continue
                got = tuple(fold(list(stream(found))))
                key = host, skeleton(found), tuple(t[1:3] for t in got)
                seen = table.get(key)
                size += len(got) if seen is None else 0
                table[key] = got if seen is None else tuple((x[0], x[1], x[2], *_both(x, y)) for x, y in zip(seen, got, strict=True))
                if size > 400_000:
                    yield out()
                    table.clear()
                    size = 0
        yield out()

    columns = "host string, skeleton string, wrapper string"
    streams = base.select("host", "html").mapInArrow(survey, columns)

    def merged(rows: pa.Table) -> pa.Table:
        wrapper = joined([read(t) for t in sorted(rows["wrapper"].to_pylist(), key=lambda r: (len(r), r))])
        return pa.table([rows["host"][:1], rows["skeleton"][:1], pa.array([written(wrapper)], pa.string())], names=["host", "skeleton", "wrapper"])

    # shares of a skeleton first, then the skeleton: a group has at most a row a task and table, never a host's pages
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(16))
    part = streams.withColumn("salt", salt).groupBy("host", "skeleton", "salt").applyInArrow(lambda t: merged(t.drop_columns(["salt"])), columns)
    wrappers = part.groupBy("host", "skeleton").applyInArrow(merged, columns)

    def choose(source):
        for batch in source:
            slots = ["\n".join([k, *("\t".join(t) for t in decided(read(w)))]) for k, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.string())], names=["host", "slots"])

    slots = keep(wrappers.mapInArrow(choose, "host string, slots string").groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("slots")), "\n\n").alias("slots")))
    weight = slots.agg(F.sum(F.octet_length("host") + F.octet_length("slots") + 32)).first()[0] or 0
    # pages meet their host's wrappers where they lie while all fit, in a join by host beyond that
    with_slots = base.join(F.broadcast(slots) if weight <= max_broadcast else slots, "host", "left").select("id", "url", "html", "slots")

    def run(source):
        wanted, wrappers, places = None, {}, {}
        for batch in source:
            texts = []
            for page, hosted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = blocks(page)
                if not own_of(found):
                    texts.append("")
                    continue
                if hosted != wanted:
                    wanted, places = hosted, {}
                    wrappers = {x.partition("\n")[0]: [tuple(y.split("\t")) for y in x.split("\n")[1:]] for x in hosted.split("\n\n")}
                parts = runs(found)
                shape = skeleton(found), tuple(found[r[0]][0] for r in parts)
                if shape not in places:
                    if len(places) > 256:
                        places.clear()
                    places[shape] = matched(list(shape[1]), wrappers[shape[0]])
                kept = []
                for r, (kind, _, fixed) in zip(parts, places[shape], strict=True):
                    if kind != "-":
                        template = set(fixed.split())
                        kept += [found[i][1] for i in r if not template or digest(found[i][1]) not in template]
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return with_slots.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
