"""Main text of web pages by a minimum cut: block classifier costs are terminal capacities, adjacency and nearness in the tree are smoothness edges."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Comments, declarations and tags whose attributes are plainly written; other tags are read character by character.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'=<>]+))?)*\s*/?)>|<(?=/?[A-Za-z])""", re.DOTALL)
_TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_AFTER_NAME = re.compile(r"\s*=\s*")
_ATTRIBUTE_NAME = re.compile(r"[^\s/>=][^\s/>=]*")
_UNQUOTED = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>]+))?""")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_READ = frozenset("class id role style aria-hidden hidden".split())

#: Elements that begin and end blocks of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of the page.
DROPPED = frozenset("head script style noscript template iframe noframes select textarea datalist title".split())
#: Of these the content is raw: markup inside doesn't count.
RAW = frozenset("script style textarea title iframe noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that closes an open one of its group, up to the listed borders.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
TAG_CUES = {"article": "article", "main": "article", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "search": "form"}
ROLE_CUES = {"main": "article", "article": "article", "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "note": "notice"}
#: Words of class and id names, by what they announce.
NAME_CUES = {
    w: cue
    for cue, words in {
        "comment": "comment comments commentlist disqus respond replies reply discussion",
        "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
        "header": "masthead topbar header",
        "footer": "footer copyright colophon legal",
        "side": "sidebar aside related recommended widget share sharing social tags trending popular",
        "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer",
        "form": "login search form",
        "article": "article story entry post",
    }.items()
    for w in words.split()
}
#: Names that begin with one of the first words, or end in one of the second, describe an element (a page that has a sidebar, a post's tag) and announce nothing.
DESCRIBES = frozenset("has with no without is tag category type format status single hentry".split())
WRAPS = frozenset("body content text wrapper wrap container page layout main open closed enabled disabled".split())
#: A part of the page with a name, or with a heading or article inside, that holds more than half of the words outside links, and this many, is a wrapper, unless
#: it stands beside an article that says so by name and holds a paragraph: a sidebar or footer may be longer than the article. Fewer words can't tell a wrapper.
WRAPPER_WORDS = 40
#: How much a counted feature can say, by group: (least, most) log odds.
BOUNDS = {"words": (-1.0, 1.0), "links": (-2.0, 0.75), "tag": (-0.5, 0.5), "stop": (-0.5, 0.5)}
#: Log odds of the place. It isn't counted, as places are also what tells which blocks to count: 50 to 1 by a name, little for a block that stands nowhere
#: by name (what isn't the article mostly has one). A named part of prose stays out by it; links and stubs inside an article can outweigh it.
PLACE = {"article": math.log(50), "": 0.5} | dict.fromkeys("menu header footer side form notice advert comment".split(), -math.log(50))
#: Smoothness: adjacent blocks (less if they stand far apart in the tree), and blocks with the same parent that aren't adjacent.
ADJACENT, SIBLING = 1.5, 0.5


@dataclass
class Block:
    text: str
    tag: str
    cue: str
    linked: int
    path: tuple[int, ...]


def _announced(name: str) -> str:
    """What a class or id name announces: the last of its words that is a cue; "" if it only describes."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in DESCRIBES or words[-1] in WRAPS:
        return ""
    return next((NAME_CUES[w] for w in reversed(words) if w in NAME_CUES), "")


def _cue(tag: str, attributes: dict[str, str], inside: str) -> tuple[str, bool]:
    """(where an element stands, given where its parent does; whether a name says so). Comments stay comments; a header inside the article belongs to it."""
    if inside == "comment":
        return inside, False
    own, named = TAG_CUES.get(tag, ""), False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return "notice", False
    role = ROLE_CUES.get(attributes.get("role", "").strip().lower())
    if role:
        own = role
    if tag not in ("html", "body"):
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            found = _announced(name)
            if found and (own in ("", "article") or found == "comment"):
                own, named = found, True
    if own == "header" and inside == "article" or not own:
        return inside, False
    if own == "article" and inside not in ("", "article"):
        return inside, False  # a teaser in a sidebar isn't the article; wrappers are told apart once the page is read
    return own, named


def _read_tag(page: str, at: int, unclosed: set[str]) -> tuple[str, str, dict[str, str], bool, int]:
    """(slash, name, attributes, self-closing, end) of the tag at a place, as browsers read it: a quote opens a value only right after an equals sign.

    A quote that is never closed counts as a character; unclosed remembers which ones, so that the rest of the page is looked through once.
    """
    m = _TAG_NAME.match(page, at)
    i, n, found, closed = m.end(), len(page), {}, False
    while i < n and page[i] != ">":
        c = page[i]
        if c == "/" or c.isspace():
            closed = c == "/"
            i += 1
            continue
        closed = False
        name = _ATTRIBUTE_NAME.match(page, i)
        if not name:  # an equals sign in front of a name
            i += 1
            continue
        i, value = name.end(), ""
        equals = _AFTER_NAME.match(page, i)
        if equals:
            i = equals.end()
            quote = page[i : i + 1]
            if quote in ("'", '"') and quote not in unclosed:
                end = page.find(quote, i + 1)
                if end < 0:
                    unclosed.add(quote)
                else:
                    value, i = page[i + 1 : end], end + 1
                    found.setdefault(name[0].lower(), value)
                    continue
            plain = _UNQUOTED.match(page, i)
            value, i = plain[0], plain.end()
        found.setdefault(name[0].lower(), value)
    return m[1], m[2].lower(), found, closed, min(n, i + 1)


@dataclass
class _Part:
    """An open element: name, cue and the part that set it, number; what it holds counts for whether it is a wrapper."""

    name: str
    cue: str
    number: int
    owner: _Part | None
    above: _Part | None
    named: bool = False
    words: int = 0
    titled: bool = False
    main: bool = False
    in_article: bool = False


def blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page, in order; null and empty pages have none. Character references are decoded, white space becomes one blank."""
    if not page:
        return []
    out: list[tuple[Block, _Part | None]] = []
    stack: list[_Part] = []
    parts: list[str] = []
    unclosed: set[str] = set()
    endless: set[str] = set()
    at, number, links, linked, dropped, plain_words = 0, 0, 0, 0, "", 0
    told = False  # whether an article by name holds a paragraph

    def flush() -> None:
        nonlocal linked, plain_words, told
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            owner = stack[-1].owner if stack else None
            out.append((Block(text, next((e.name for e in reversed(stack) if e.name in BLOCKS), ""), owner.cue if owner else "", linked, tuple(e.number for e in stack)), owner))
            told = told or out[-1][0].tag == "p" and out[-1][0].cue == "article"
            n = round((text.count(" ") + 1) * (1 - min(1.0, linked / len(text))))
            plain_words += n
            part = owner
            while part:
                part.words, part = part.words + n, part.above
        parts.clear()
        linked = 0

    def mark(name: str) -> None:
        """Tell all parts that hold this element of a heading or an article."""
        part = stack[-1].owner if stack else None
        while part:
            part.titled, part.main, part = True, part.main or name == "main", part.above

    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            text = entities.unescape(page[at:stop])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        if m[2]:
            at, slash, name = m.end(), m[1], m[2].lower()
            attributes = None
            closed = m[3].endswith("/")
        elif m[0] == "<":
            slash, name, attributes, closed, at = _read_tag(page, stop, unclosed)
        else:
            at = m.end()
            continue
        if slash:
            if dropped:
                dropped = "" if name == dropped else dropped
            elif name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            continue
        if dropped:
            continue
        if name in RAW or name in DROPPED:
            if closed and name not in RAW or name in endless:
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            if name in RAW:
                at = end.end() if end else len(page)
            elif not end:
                endless.add(name)
            else:
                body = re.compile(r"<body\b", re.IGNORECASE).search(page, at, end.start()) if name == "head" else None
                if body:
                    at = body.start()
                else:
                    dropped = name
            continue
        if name == "a":
            links += 1
        elif name == "br":
            parts.append("\n")
        elif name in BLOCKS:
            flush()
            while stack and stack[-1].name == "p":
                stack.pop()
            if name in CLOSES:
                same, border = (set(x.split()) for x in CLOSES[name])
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in border:
                        break
                    if stack[k].name in same:
                        del stack[k:]
                        break
            if name in ("h1", "article", "main"):
                mark(name)
            if name not in VOID:
                number += 1
                above = stack[-1].owner if stack else None
                inside = above.cue if above else ""
                if attributes is None:
                    attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3] and not _READ.isdisjoint(re.findall(r"[a-z-]+", m[3].lower())) else {}
                cue, named = _cue(name, attributes, inside)
                own = cue != inside or named
                part = _Part(name, cue, number, None, above, named, in_article=bool(above) and (above.in_article or above.cue == "article"))
                part.owner = part if own else above
                stack.append(part)
    flush()

    def place(part: _Part | None) -> str:
        """The cue of the innermost part that isn't a mere wrapper."""
        while part and part.cue != "article":
            most = part.words >= WRAPPER_WORDS and 2 * part.words > plain_words and (part.in_article or not told)
            if not (part.main or part.cue != "comment" and most and (part.named or part.titled and part.cue != "header")):
                break
            part = part.above
        return part.cue if part else ""

    for b, owner in out:
        b.cue = place(owner)
    return [b for b, _ in out]


def block_features(b: Block) -> list[str]:
    """What is counted of a block: its tag, its length, the share of links, how it ends."""
    n = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, len(b.text)))
    return [f"tag-{b.tag}", f"words-{min(6, int(math.log2(n)))}", f"links-{int(density * 3)}", f"stop-{b.text[-1] in '.!?:;…”\"'}"]


@dataclass
class BlockModel:
    """Log odds of content by feature; with those of the place they are a block's own cost."""

    odds: dict[str, float] = field(default_factory=dict)

    def cost(self, b: Block) -> float:
        return PLACE[b.cue] + sum(self.odds.get(f, 0.0) for f in block_features(b))


#: Blocks that stand for each class before any page is seen, by feature: (content, other).
PRIOR = {
    "links-0": (30, 10), "links-1": (8, 12), "links-2": (2, 20), "links-3": (2, 40), "words-0": (4, 16), "words-1": (6, 16), "words-2": (10, 14), "words-3": (20, 10), "words-4": (30, 6), "words-5": (30, 3), "words-6": (30, 2),
    "tag-p": (40, 10), "tag-li": (8, 24), "tag-div": (10, 16), "tag-h1": (20, 6), "tag-h2": (20, 6), "tag-h3": (16, 8), "tag-h4": (12, 8), "stop-True": (40, 12), "stop-False": (12, 40),
}


def train(pages: DataFrame, max_pages: int = 2000, id_col: str = "page_id", html_col: str = "html") -> BlockModel:
    """Learn the block classifier from about max_pages pages (a documented bound; chosen by a hash of the id).

    Blocks that stand in an article by name count as content and those in menus, footers and the like as not. What they look like (tag, length, links, last
    mark) gets the log odds of these counts and of PRIOR's, held within BOUNDS; the place itself isn't counted, so that it isn't learned from its own label.
    A block that stands nowhere by name is judged by its looks and by its neighbours.
    Features are counted on the executors, and their sums, one row a feature, reach the driver.
    """
    bound_batches(pages.sparkSession)
    n = pages.count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("html")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for b in blocks(page):
                    if b.cue:
                        seen.update((f, b.cue == "article") for f in block_features(b))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], ["feature", "content", "n"])

    got = pages.filter(place < min(1.0, max_pages / max(1, n))).select(F.col(html_col).alias("html")).mapInArrow(count, "feature string, content boolean, n long").groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()
    sums = {f: list(x) for f, x in PRIOR.items()}
    for r in got:
        sums.setdefault(r.feature, [1, 1])[0 if r.content else 1] += r.n
    total: dict[str, list[float]] = {}
    for f, (a, b) in sums.items():
        group = total.setdefault(f.split("-")[0], [0, 0])
        group[0], group[1] = group[0] + a, group[1] + b
    odds = {f: math.log(a / total[f.split("-")[0]][0]) - math.log(b / total[f.split("-")[0]][1]) for f, (a, b) in sums.items() if a and b}
    return BlockModel({f: max(BOUNDS[f.split("-")[0]][0], min(BOUNDS[f.split("-")[0]][1], x)) for f, x in odds.items()})


def _source_side(cost: list[float], index: dict[int, int], near: list[dict[int, float]], group: list[int]) -> list[bool]:
    """Which nodes of a connected group are on the source's (content) side of the least cut: blocking flows over shortest paths until none is left."""
    n, source, sink = len(group), len(group), len(group) + 1
    room: list[dict[int, float]] = [{index[j]: w for j, w in near[i].items() if j in index} for i in group] + [{}, {}]
    for k, c in enumerate(cost):
        room[source][k], room[k][source] = max(0.0, c), 0.0
        room[k][sink], room[sink][k] = max(0.0, -c), 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        left = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= 1e-12)
                del path[full + 1 :]
                left[path[-1]] = iter(list(room[path[-1]]))
                continue
            step = next((v for v in left[u] if room[u][v] > 1e-12 and level.get(v) == level[u] + 1), None)
            if step is None:
                level.pop(u)  # no way on from here in this round
                path.pop()
            else:
                path.append(step)


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of costs: True is content. unary > 0 is the cost of False, < 0 that of True; an edge costs its weight if its ends differ.

    Nodes whose cost outweighs all their edges are settled first, exactly; maximum flow by shortest augmenting paths separates the rest.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    cost, label = list(unary), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = cost[i] >= 0
            for j, w in near[i].items():
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    queue.append(j)
    for first in range(n):
        if label[first] is None:  # the unsettled nodes that hang together with this one
            group, seen = [first], {first}
            for i in group:
                for j in near[i]:
                    if label[j] is None and j not in seen:
                        seen.add(j)
                        group.append(j)
            inside = _source_side([cost[i] for i in group], {i: k for k, i in enumerate(group)}, near, group)
            for k, i in enumerate(group):
                label[i] = inside[k]
    return [bool(x) for x in label]


def judged(page: str | None, model: BlockModel) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their own costs (positive: content), and their labels by the minimum cut."""
    found = blocks(page)
    unary = [model.cost(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        parent = b.path[-2] if len(b.path) > 1 else 0
        if i:
            shared = 0
            for x, y in zip(found[i - 1].path, b.path, strict=False):
                if x != y:
                    break
                shared += 1
            edges.append((i - 1, i, ADJACENT * (shared + 1) / (max(len(b.path), len(found[i - 1].path)) + 1)))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return found, unary, min_cut(unary, edges) if found else []


def main_text(page: str | None, model: BlockModel) -> str:
    """The main text of a page; "" if there is none."""
    return cut_text(page, model)[0]


def cut_text(page: str | None, model: BlockModel) -> tuple[str, int]:
    """(the main text of a page: the blocks on the content side of the minimum cut, in order, joined by an empty line; how many blocks the cut moved)."""
    found, unary, label = judged(page, model)
    return "\n\n".join(b.text for b, keep in zip(found, label, strict=True) if keep), sum((u >= 0) != keep for u, keep in zip(unary, label, strict=True))


def extract(pages: DataFrame, model: BlockModel, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Rows (id, *keep, text, n_chars, n_moved), one for each row of pages, from the whole html. Null and empty pages have the text "".

    n_chars counts code points; n_moved the blocks whose label is another by the cut than by their own cost. Rows that repeat, or repeat an id, keep a row
    each; an empty table gives an empty one; columns that keep doesn't name are left behind, whatever their names. Time grows with a page's length,
    whatever its markup: a quote that is never closed, or an element without an end, is looked for once.
    """
    bound_batches(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [cut_text(x.as_py(), shipped.value) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())], [*b.schema.names[:-1], "text", "n_chars", "n_moved"])

    slim = pages.select(pages[id_col].alias("k0"), *(pages[c].alias(f"k{i + 1}") for i, c in enumerate(keep)), pages[html_col].alias("html"))
    schema = ", ".join(f"{c} {t}" for c, t in slim.dtypes[:-1])
    out = slim.mapInArrow(work, f"{schema}, text string, n_chars long, n_moved long")
    return out.select(F.col("k0").alias(id_col), *(F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)), "text", "n_chars", "n_moved")
