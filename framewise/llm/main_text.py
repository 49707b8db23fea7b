"""The main text of web pages: blocks are labelled as content or boilerplate by a minimum cut.

A page is read into blocks, the stretches of text between tags of block level. A block's score is the log odds that it is content: a weight
for the container it stands in (article, nav, a class that names an advert, ...) and a text classifier's, a logistic function of how
long it is, how much of it is links, whether it ends as a sentence and which tag it has. That classifier is fitted here on all pages: blocks within a
named container are its examples, counted by pattern of features (at most PATTERNS x 2 rows reach the driver), with a Gaussian
prior about set weights, which an empty table leaves as they are. Costs become capacities to the two terminals; blocks in a row and blocks
of one parent are joined by edges, the stronger the fewer tags lie between them. Of all minimum cuts the one with the fewest content blocks counts.

Blocks whose own capacity outweighs their edges are settled first, which changes no minimum cut; what is left goes through Dinic's maximum flow.
A page is one task's work and no page meets another: no shuffle but for the counts of patterns.

Defined results: null and empty html have an empty text; character references are decoded; any white space within a block, no-break spaces too, is
one space; a page cut off in a tag, comment or script loses that tag, comment or script only; a quote that isn't closed until
the end of the page makes tags end at their first '>' from there on; repeated rows are rows of their own; an empty table gives no rows. Other columns stay, `text` and `blocks` replace
columns of those names."""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts, read_table

# What HTML calls its elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED_TAGS = frozenset("noscript template svg math select button object canvas audio video datalist".split())
ENDS_AT = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}

# Set values of the container part: what elements, roles and words of class and id say.
GOOD_TAGS, BAD_TAGS = frozenset(["article", "main"]), frozenset("nav aside footer dialog menu".split())
WEAK_BAD_TAGS = frozenset(["header", "form"])
GOOD_ROLES, BAD_ROLES = frozenset(["main", "article"]), frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
GOOD_WORDS = frozenset("article content entry main post story body text".split())
BAD_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side rail menu nav navbar
    navigation breadcrumb breadcrumbs header masthead topbar footer foot comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login
    widget pagination pager toolbar copyright legal disclaimer skip search""".split()
)
GOOD, BAD, WEAK_BAD, NONE = 3, 0, 1, 2
CONTAINER = {GOOD: 4.0, BAD: -6.0, WEAK_BAD: -3.5, NONE: 0.0}

#: Text features: a tag kind, a share of links, a length and an end; set weights are the prior of the fit.
KINDS, LINKS, LENGTHS = ("other", "heading", "item", "cell"), (0.05, 0.5), (5, 15, 40, 80)
PATTERNS = len(KINDS) * (len(LINKS) + 1) * (len(LENGTHS) + 1) * 2
PRIOR = np.array([0.0, 0.3, -0.6, -0.4] + [0.8, -0.5, -2.0] + [-0.8, -0.2, 0.4, 0.9, 1.2] + [-0.3, 0.4])
PRIOR_WEIGHT, TEXT_BOUND = 50.0, 2.0
NEAR, SIBLING, UNIT = 1.0, 0.5, 1000


@dataclass(slots=True)
class Block:
    text: str
    container: int
    pattern: int
    apart: int  # tags of block level between the block before and this one
    sibling: int  # the last block before it with the same parent, or -1


def _container(name: str, attrs: str, inside: int) -> int:
    """What an element says about its contents, given what its parents say."""
    if inside == BAD:
        return BAD
    role, words = None, ()
    if "=" in attrs or "hidden" in attrs:
        found = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in re.findall(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", attrs)}
        role = found.get("role", "").lower()
        words = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{found.get('class', '')} {found.get('id', '')}").lower())
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return BAD
    if name in BAD_TAGS or role in BAD_ROLES:
        return BAD
    if name not in ("html", "body"):
        good, bad = not GOOD_WORDS.isdisjoint(words), not BAD_WORDS.isdisjoint(words)
        if bad and not good and name not in GOOD_TAGS or not {"comment", "comments"}.isdisjoint(words):
            return BAD
        if name in GOOD_TAGS or role in GOOD_ROLES or good and not bad:
            return GOOD
    if name in WEAK_BAD_TAGS and inside != GOOD:
        return WEAK_BAD
    return inside


_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


def _pattern(kind: str, text: str, linked: int) -> int:
    of = "heading" if kind in ("h1", "h2", "h3", "h4", "h5", "h6") else "item" if kind in ("li", "dt", "dd") else "cell" if kind in ("td", "th") else "other"
    words, share = text.count(" ") + 1, linked / len(text)
    values = KINDS.index(of), sum(share > x for x in LINKS), sum(words >= x for x in LENGTHS), int(text[-1] in ".!?…。！？\"”»)" and text[-2:-1] != "")
    out = 0
    for v, n in zip(values, (len(KINDS), len(LINKS) + 1, len(LENGTHS) + 1, 2)):
        out = out * n + v
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    found: list[Block] = []
    names, says, ids, dropped = [""], [NONE], [0], [False]  # the open elements
    open_count: dict[str, int] = {}
    level = lowest = at_last = 0  # open elements of block level: now, fewest since the last block, at the last block
    last_of: dict[int, int] = {}
    held: list[str] = []
    linked, n_ids, quotes, at, n = 0, 0, True, 0, len(page)

    def flush() -> None:
        nonlocal linked, lowest, at_last
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            i = len(names) - 1
            while i and names[i] not in BLOCK_TAGS:
                i -= 1
            parent = ids[max(i - 1, 0)]
            found.append(Block(text, says[-1], _pattern(names[i], text, min(linked, len(text))), at_last + level - 2 * lowest, last_of.get(parent, -1)))
            last_of[parent] = len(found) - 1
            at_last = lowest = level
        linked = 0

    def pop() -> None:
        nonlocal level, lowest
        name = names.pop()
        says.pop(), ids.pop(), dropped.pop()
        open_count[name] -= 1
        if name in BLOCK_TAGS:
            level -= 1
            lowest = min(lowest, level)

    def close(name: str, within: tuple[str, ...] = ()) -> None:
        """Close the innermost element of that name, and what is open in it; not past an element of `within`."""
        if not open_count.get(name):
            return
        i = len(names) - 1
        while names[i] != name:
            if names[i] in within:
                return
            i -= 1
        while len(names) > i:
            pop()

    while at < n:
        to = page.find("<", at)
        to = n if to < 0 else to
        if to > at and not dropped[-1]:
            piece = page[at:to]
            piece = html_lib.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if open_count.get("a"):
                linked += len(piece)
        if to >= n:
            break
        if page.startswith("<!--", to):
            end = page.find("-->", to + 4)
            at = n if end < 0 else end + 3
            continue
        ends = page.startswith("</", to)
        name = _NAME.match(page, to + 1 + ends)
        if not name:
            if page[to + 1 : to + 2] in ("!", "?", "/"):
                end = page.find(">", to)
                at = n if end < 0 else end + 1
            else:
                held.append("" if dropped[-1] else "<")
                at = to + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            break
        if quotes and ('"' in (attrs := page[name.end() : end]) or "'" in attrs):
            whole = _QUOTED.match(page, name.end())
            quotes = whole is not None
            end = whole.end() - 1 if whole else end
        attrs, name = page[name.end() : end], name[0].lower()
        at = end + 1
        if name in BLOCK_TAGS:
            flush()
        if ends:
            close(name)
        elif name in RAW_TAGS:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = n if end < 0 else end + 1
        elif name in VOID_TAGS:
            if name == "br":
                held.append(" ")
        else:
            if name in BLOCK_TAGS:
                close("p", ("table", "td", "th"))
                if name in ENDS_AT:
                    for other in ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,):
                        close(other, ENDS_AT[name])
                level += 1
            n_ids += 1
            says.append(_container(name, attrs, says[-1])), names.append(name), ids.append(n_ids)
            dropped.append(dropped[-1] or name in DROPPED_TAGS)
            open_count[name] = open_count.get(name, 0) + 1
    flush()
    return found


def _features(patterns: np.ndarray) -> np.ndarray:
    """0/1 rows of the values that patterns stand for."""
    out, rest, columns = [], patterns, []
    for n in (2, len(LENGTHS) + 1, len(LINKS) + 1, len(KINDS)):
        columns.append((rest % n, n))
        rest = rest // n
    for v, n in reversed(columns):
        out.append(v[:, None] == np.arange(n))
    return np.concatenate(out, axis=1).astype(float)


def fit(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """The log odds of content of each pattern, from (pattern, label, blocks): logistic regression with a Gaussian prior about PRIOR, by Newton's
    method, within TEXT_BOUND."""
    x = _features(np.arange(PATTERNS))
    yes, no = np.zeros(PATTERNS), np.zeros(PATTERNS)
    for pattern, label, n in counts:
        (yes if label else no)[pattern] += n
    most = max(1.0, (yes + no).sum() / 10_000)  # a corpus of any size counts as ten thousand blocks, so the prior keeps its say
    yes, no, w = yes / most, no / most, PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (yes - (yes + no) * p) - PRIOR_WEIGHT * (w - PRIOR)
        bend = (x * ((yes + no) * p * (1 - p))[:, None]).T @ x + PRIOR_WEIGHT * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.clip(x @ w, -TEXT_BOUND, TEXT_BOUND)


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side: the smallest set S that maximises the sum of gain over S less the weights of edges (a, b, weight)
    with one end in S."""
    n = len(gain)
    gain, near = list(gain), [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or -weight[i] < gain[i] <= weight[i]:
            continue
        side[i] = gain[i] > weight[i]
        for j, w in near[i].items():
            if side[j] is None:
                gain[j] += w if side[i] else -w
                weight[j] -= w
                queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        inside = _max_flow(left, gain, near, side)
        for i in left:
            side[i] = i in inside
    return [bool(x) for x in side]


def _max_flow(nodes: list[int], gain: list[int], near: list[dict[int, int]], side: list[bool | None]) -> set[int]:
    """What the source reaches in the residual graph of a maximum flow (Dinic): gain > 0 is capacity from the source, gain < 0 to the sink."""
    source, sink = -1, -2
    cap: dict[int, dict[int, int]] = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in nodes}
    cap[source], cap[sink] = {i: gain[i] for i in nodes if gain[i] > 0}, {}
    for i in nodes:
        if gain[i] > 0:
            cap[i][source] = 0
        elif gain[i] < 0:
            cap[i][sink] = -gain[i]
            cap[sink][i] = 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        steps = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if not cap[a][b])
                del path[cut + 1 :]
                continue
            for v in steps[u]:
                if cap[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level.pop(u)


def label(found: list[Block], odds: np.ndarray) -> list[bool]:
    """Whether each block of a page is content."""
    gain = [round(UNIT * (CONTAINER[b.container] + float(odds[b.pattern]))) for b in found]
    edges = [(i - 1, i, round(UNIT * NEAR / (1 + b.apart))) for i, b in enumerate(found) if i]
    edges += [(b.sibling, i, round(UNIT * SIBLING)) for i, b in enumerate(found) if 0 <= b.sibling < i - 1]
    return min_cut(gain, edges)


def text_model(pages: DataFrame, html: str = "html") -> np.ndarray:
    """The text classifier: log odds by pattern, from all blocks of all pages that stand in a named container."""

    def examples(texts: list) -> list[list]:
        rows = []
        for t in texts:
            seen: dict[int, int] = {}
            for b in blocks(t.decode("utf-8", "replace")) if t else []:
                if b.container != NONE:
                    key = 2 * b.pattern + (b.container == GOOD)
                    seen[key] = seen.get(key, 0) + 1
            rows.append([{"key": k, "n": v} for k, v in seen.items()])
        return [rows]

    kind = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    counts = map_texts(pages, examples, [T.StructField("seen", kind)], html, keep=[]).select(F.inline("seen")).groupBy("key").agg(F.sum("n").alias("n"))
    return fit(sorted((r["key"] // 2, r["key"] % 2, r["n"]) for r in counts.collect()))


def extract(pages: DataFrame, html: str = "html", odds: np.ndarray | None = None) -> DataFrame:
    """pages with their main text, and blocks: (text, content) of each."""
    odds = text_model(pages, html) if odds is None else odds

    def run(texts: list) -> list[list]:
        out, each = [], []
        for t in texts:
            found = blocks(t.decode("utf-8", "replace")) if t else []
            keep = label(found, odds)
            out.append(" ".join(b.text for b, k in zip(found, keep) if k))
            each.append([{"text": b.text, "content": k} for b, k in zip(found, keep)])
        return [out, each]

    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.BooleanType())]))
    return map_texts(pages, run, [T.StructField("text", T.StringType()), T.StructField("blocks", kind)], html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
