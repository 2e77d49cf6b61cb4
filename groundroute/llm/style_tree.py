"""HTML extraction with site style trees.

The pages of a host are merged into one tree of element nodes (tag with class or id, below the
same parent). A node's presentation importance is the normalised entropy of the child
sequences it shows over the pages; a content node's importance is one less the normalised
entropy of its texts over the pages (text that every page repeats says nothing), or the share of its texts that would stay on one page alone (text from
a small store says little), whichever is less. Composite importance
combines a node's own with its children's, and goes towards 1 where few pages show the node.
What an element says of itself (its tag, role, id and class) is a prior: the importance that decides is prior times composite,
and branches where it is low are removed from each page, inside article and main elements and outside.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache
from math import log

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Below this importance a branch is noise; weight of children; what the evidence of the pages is weighed against (in pages).
LEAST_IMPORTANCE, GAMMA, DOUBT = 0.25, 0.9, 6.0
#: Pages over which a text has to stay the only one of its kind to count in full; what evidence of that kind is weighed against (in pages of the host).
REACH, REACH_DOUBT = 50, 12.0
#: Priors: never text; says it isn't the article; half says so; says nothing; article or main.
UNSEEN, NOISE, MIXED, PLAIN, CONTENT = 0.0, 0.1, 0.4, 0.7, 1.0
#: How often a character inside an article or main element counts against one outside.
LANDMARK_WEIGHT = 2

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
MARKUP = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_split = lambda s: frozenset(s.split())
VOID = _split("area base br col embed hr img input link meta param source track wbr")
RAW = _split("script style textarea title xmp noembed noframes")
HEAD = _split("title meta link script style base noscript template head")
BLOCK = _split("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul")
CLOSES_P = BLOCK - _split("td th tr tbody thead tfoot caption option optgroup legend html body")
#: A start tag ends an open element of these, up to the border named.
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist")}
IMPLIED = {k: (_split(a), _split(b)) for k, (a, b) in IMPLIED.items()}
#: Never rendered as text of a page, or part of a form's controls; and what isn't the article by its tag's meaning.
DROPPED = _split("head script style noscript template title button select option optgroup datalist input textarea label legend output iframe frame frameset noframes noembed svg canvas object applet audio video map xmp")
CHROME = _split("nav footer aside dialog menu")
LANDMARK = _split("article main")
NOISE_ROLES = _split("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar")
NOISE_WORDS = _split(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adsbygoogle sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "masthead topbar footer foot sidebar sidebars aside notice notices cookie cookies cookiebar cookiebanner consent gdpr popup modal overlay alert banner newsletter subscribe subscription signup signin login "
    "social share sharing sharer related recommended recommendations widget widgets comment comments commentlist commentform disqus reply replies respond form search pagination pager toolbar copyright disclaimer"
)
CONTENT_WORDS = _split("article content main post entry story")
#: Words that name a place or a shape, not what stands there.
FILLER = _split("site page wrapper container wrap inner outer box list item items area block section left right top bottom col column row body text link links group holder slot unit bar panel module region zone")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def named(label: str) -> float:
    """What ids and classes say: each is a compound whose last telling word is what it names."""
    says = set()
    for token in label.split():
        words = [w for w in (x.lower() for x in WORDS.findall(token)) if w not in FILLER]
        if words and words[-1] in NOISE_WORDS:
            says.add(NOISE)
        elif NOISE_WORDS.intersection(words):
            says.add(MIXED)
        elif words and words[-1] in CONTENT_WORDS:
            says.add(CONTENT)
    if CONTENT in says:
        return MIXED if NOISE in says else PLAIN
    return min(says, default=PLAIN)


def said(tag: str, attrs: str) -> tuple[float, bool, str]:
    """The prior of an element, whether it is a header by name, and its signature in the style tree."""
    return _said_often(tag, attrs) if len(attrs) <= 200 else _said(tag, attrs)


def _said(tag: str, attrs: str) -> tuple[float, bool, str]:
    found = {}
    if attrs and attrs != "/":
        for name, a, b, c in ATTR.findall(attrs):
            found.setdefault(name.lower(), a or b or c)
    label = f"{found.get('id', '')} {found.get('class', '')}".strip()
    sign = f"{tag}.{re.sub(r'[0-9]+', '#', label)}" if label else tag
    if tag in DROPPED or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        return UNSEEN, False, sign
    role = found.get("role", "").lower()
    if tag in CHROME or role in NOISE_ROLES and tag != "form":
        return NOISE, False, sign
    if tag in ("html", "body"):
        return PLAIN, False, sign
    prior = named(label)
    if prior == NOISE or tag == "form":
        return NOISE, False, sign
    if tag in LANDMARK or role in ("main", "article"):
        return CONTENT, False, sign
    words = [x.lower() for x in WORDS.findall(label)]
    return prior, tag == "header" or bool(words) and words[-1] == "header", sign


_said_often = lru_cache(maxsize=4096)(_said)


class Page:
    """nodes: (parent, tag, prior, header, sign); blocks: lists of (node, text). Parsing is linear: what is open
    is looked up by tag, not searched for in the stack."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, float, bool, str]] = [(-1, "#", PLAIN, False, "#")]
        self.blocks: list[list[tuple[int, str]]] = []
        stack, block, at = [0], [], 0
        nodes = self.nodes
        depths: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
        blocks_open: list[int] = []  # where in the stack block elements are

        def end_block() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def close(depth: int) -> None:
            ends = False
            for d in range(len(stack) - 1, depth - 1, -1):
                tag = nodes[stack[d]][1]
                depths[tag].pop()
                if tag in BLOCK:
                    blocks_open.pop()
                    ends = True
            del stack[depth:]
            if ends:
                end_block()

        top = lambda tags: max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        for m in iter(lambda: MARKUP.search(source, at), None):
            if m.start() > at:
                text = source[at : m.start()]
                block.append((stack[-1], html_lib.unescape(text) if "&" in text else text))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                if depths.get(tag):
                    close(depths[tag][-1])
                elif tag == "p":
                    end_block()
                continue
            if tag not in HEAD and depths.get("head"):
                close(depths["head"][0])
            if tag in IMPLIED:
                tags, border = IMPLIED[tag]
                least = top(border)
                while (d := top(tags)) > least:
                    close(d)
            elif tag in CLOSES_P:
                while blocks_open and nodes[stack[blocks_open[-1]]][1] == "p":
                    close(blocks_open[-1])
            if tag in BLOCK:
                end_block()
            nodes.append((stack[-1], tag, *said(tag, m[3] or m[6] or "")))
            if tag == "br":
                block.append((stack[-1], " "))
            if tag in VOID:
                continue
            depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks_open.append(len(stack))
            stack.append(len(nodes) - 1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
                if not end:
                    break
        if at < len(source):
            block.append((stack[-1], html_lib.unescape(source[at:])))
        end_block()

    def paths(self) -> list[int]:
        """The style-tree node of each node: a hash of the signatures above it. Inline elements are their parent's."""
        out = []
        for parent, tag, _, _, sign in self.nodes:
            above = out[parent] if parent >= 0 else 0
            out.append(xxhash.xxh64_intdigest(f"{above}>{sign}") >> 1 if tag in BLOCK or parent < 0 else above)
        return out

    def priors(self, names: bool | str) -> tuple[list[float], list[bool], list[bool]]:
        """The prior of each node in its place; which nodes hold an article; which lie inside one. names: what
        elements say counts ("tags": but for ids and classes that tell of noise); else all that is rendered is alike."""
        nodes = self.nodes
        own, holds, inside = [n[2] for n in nodes], [False] * len(nodes), [False] * len(nodes)
        if not names:
            return [PLAIN if p else UNSEEN for p in own], holds, inside
        if names == "tags":
            own = [PLAIN if p == NOISE and tag not in CHROME and named(sign.partition(".")[2]) == NOISE else p for p, (_, tag, _, _, sign) in zip(own, nodes)]
        for k in range(len(nodes) - 1, 0, -1):
            if own[k] == CONTENT or holds[k]:
                holds[nodes[k][0]] = True
        for k in range(1, len(nodes)):
            parent, tag, _, header, _ = nodes[k]
            inside[k] = inside[parent] or own[k] == CONTENT
            if header and not inside[k]:
                own[k] = NOISE  # a page's header, not an article's
            if holds[k] and own[k] == NOISE and tag not in CHROME:
                own[k] = PLAIN
        if any(n[1] == "form" for n in nodes):  # a form that wraps most of a page's text is no form
            size, gone = [0] * len(nodes), [False] * len(nodes)
            for k in range(1, len(nodes)):
                gone[k] = gone[nodes[k][0]] or own[k] <= NOISE and nodes[k][1] != "form"
            for block in self.blocks:
                for k, text in block:
                    size[k] += 0 if gone[k] else len(text.strip())
            for k in range(len(nodes) - 1, 0, -1):
                size[nodes[k][0]] += size[k]
            for k in range(1, len(nodes)):
                if nodes[k][1] == "form" and own[k] == NOISE and size[k] > size[0] / 2:
                    own[k] = PLAIN
        return own, holds, inside

    def kept(self, judged: dict[int, float], least: float = LEAST_IMPORTANCE, names: bool | str = True) -> tuple[list[bool], int, int]:
        """Which nodes' own text stays; how many branches are removed for low importance, and how many of them
        would be if their elements said nothing. judged: composite importance of the tree's nodes (1 if not there)."""
        nodes = self.nodes
        prior, holds, inside = self.priors(names)
        paths = self.paths() if judged else None
        keep, clean, n_low, n_repeated = [True] * len(nodes), [True] * len(nodes), 0, 0
        landmark = False
        for k in range(1, len(nodes)):
            parent, tag = nodes[k][:2]
            clean[k] = clean[parent] and prior[k] > NOISE
            landmark = landmark or prior[k] == CONTENT and clean[k]
            seen = judged.get(paths[k], 1.0) if paths and tag in BLOCK and tag not in ("html", "body") and prior[k] < CONTENT and not holds[k] else 1.0
            low = prior[k] * seen < least
            keep[k] = keep[parent] and not low
            if low and keep[parent] and prior[k]:
                n_low += 1
                n_repeated += PLAIN * seen < least
        if landmark:
            size = [0, 0]
            for block in self.blocks:
                for k, text in block:
                    if keep[k]:
                        size[inside[k]] += len(text.strip())
            if size[0] <= LANDMARK_WEIGHT * size[1]:
                keep = [a and b for a, b in zip(keep, inside)]
        return keep, n_low, n_repeated

    def extracted(self, judged: dict[int, float], least: float = LEAST_IMPORTANCE, names: bool | str = True) -> tuple[str, int, int]:
        """The text, and the counts of kept(). A page that the tree would leave empty keeps what its elements say; one that ids and
        classes would, what is left without these."""
        keep, *counts = self.kept(judged, least, names)
        text = self._joined(keep)
        if not text and judged:
            return self.extracted({}, least, names)
        if not text and names is True:
            return self.extracted({}, least, "tags")
        return text, *counts

    def _joined(self, keep: list[bool]) -> str:
        blocks = (" ".join("".join(t for k, t in block if keep[k]).split()) for block in self.blocks)
        return "\n".join(b for b in blocks if b)

    def text(self) -> str:
        """The text without a tree."""
        return self.extracted({})[0]

    def style_nodes(self):
        """(path, parent path, style) of each block node, and (path, feature) of each text block. A style is the sequence of the node's
        block children, runs of the same element with their lengths."""
        paths = self.paths()
        children: dict[int, list[list]] = {}
        for parent, tag, _, _, sign in self.nodes[1:]:
            if tag in BLOCK:
                while parent > 0 and self.nodes[parent][1] not in BLOCK:
                    parent = self.nodes[parent][0]
                mine = children.setdefault(parent, [])
                if mine and mine[-1][0] == sign:
                    mine[-1][1] += 1
                else:
                    mine.append([sign, 1])
        nodes = [(paths[k], paths[parent] if parent >= 0 else 0, xxhash.xxh64_intdigest("|".join(f"{c}*{n}" for c, n in children.get(k, ()))) >> 1) for k, (parent, tag, *_) in enumerate(self.nodes) if tag in BLOCK or parent < 0]
        features = []
        for block in self.blocks:
            if text := " ".join("".join(t for _, t in block).split()):
                features.append((paths[block[0][0]], xxhash.xxh64_intdigest(text) >> 1))
        return nodes, features


def by_entropy(texts: list[tuple[int, int]], m: int) -> float:
    """One less the normalised entropy of texts ((n, times): how many are met n times) over m showings of their node, each by itself."""
    total = sum(t * k for t, k in texts)
    return sum(k * t * (1 - min(1.0, log(t) / log(max(m, 2)))) for t, k in texts) / total


def by_recurrence(texts: list[tuple[int, int]], m: int) -> float:
    """The share of showings whose text is met nowhere else on the site, nor would be if REACH more pages were seen: a menu's texts come from a
    small store, however many showings it takes until each has recurred; an article's don't. The store's size is
    estimated from the texts met once and twice (as the number of species is from a catch)."""
    once, twice = (sum(k for t, k in texts if t == n) for n in (1, 2))
    store = sum(k for _, k in texts) + once * once / (2 * twice) if twice else float("inf")
    return once / sum(t * k for t, k in texts) * (1 - 1 / store) ** REACH if once else 0.0


def importance(host: pd.DataFrame, recurrence: bool = False) -> dict[int, float]:
    """Composite importance of the nodes of one host's tree, drawn towards 1 as if DOUBT more pages had shown the node, each
    of them otherwise. host: path, parent, kind (0: styles
    of a node, 1: texts of it), n (nodes that show one of these), times (how many there are). recurrence: texts are weighed by_recurrence (and
    doubted by REACH_DOUBT pages against those of the host) instead of by_entropy."""
    nodes: dict[int, dict] = {}
    for path, parent, kind, n, times in host[["path", "parent", "kind", "n", "times"]].itertuples(index=False):
        node = nodes.setdefault(path, {"parent": 0, "styles": [], "texts": []})
        if kind == 0:
            node["parent"] = parent
            node["styles"].append((n, times))
        else:
            node["texts"].append((n, times))
    children: dict[int, list[int]] = {}
    for path, node in nodes.items():
        node["m"] = sum(s * k for s, k in node["styles"])
        if node["parent"] != path:
            children.setdefault(node["parent"], []).append(path)
    order, todo = [], [p for p, x in nodes.items() if x["parent"] not in nodes]
    while todo:
        order.append(todo.pop())
        todo += children.get(order[-1], ())
    out: dict[int, float] = {}
    for path in reversed(order):
        node, below = nodes[path], [(out[c], nodes[c]["m"]) for c in children.get(path, ())]
        m = node["m"]
        own = -sum(k * s / m * log(s / m) for s, k in node["styles"]) / log(m) if m > 1 else 1.0
        if node["texts"]:
            below.append(((by_recurrence if recurrence else by_entropy)(node["texts"], m), m))
        if not below:
            out[path] = own
            continue
        weight = GAMMA ** len(below)
        out[path] = (1 - weight) * own + weight * sum(v * w for v, w in below) / max(1, sum(w for _, w in below))
    pages = max((x["m"] for x in nodes.values() if x["parent"] not in nodes), default=0) if recurrence else float("inf")
    seen, doubt = {p: min(nodes[p]["m"], pages) for p in out}, REACH_DOUBT if recurrence else DOUBT
    return {p: (v * seen[p] + doubt) / (seen[p] + doubt) for p, v in out.items()}


def site_importance(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, paths, importance (of the nodes of its style tree that may be low under some prior) from pages
    (row, host, html). Copies of a page count once. The rows of a host's tree are its distinct styles and texts
    by how often they are met, not its pages."""
    first = common.written(pages.groupBy("host", F.xxhash64("html").alias("h")).agg(F.min("row").alias("row")).select("row"), "site-pages")
    used = pages.join(common.small(first), "row", "left_semi")

    def trees(batches):
        seen: Counter = Counter()

        def rows():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))] + [pa.array(list(seen.values()), pa.int64())], names=["host", "path", "parent", "kind", "value", "n"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                nodes, features = Page(source.as_py() or "").style_nodes()
                seen.update((host, p, q, 0, s) for p, q, s in nodes)
                seen.update((host, p, 0, 1, f) for p, f in features)
                if len(seen) > 50_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    tree = used.select("host", "html").mapInArrow(common.tidy(trees), "host string, path long, parent long, kind int, value long, n long").groupBy("host", "path", "parent", "kind", "value").agg(F.sum("n").alias("n"))
    # values met equally often weigh the same: they are counted, not carried
    rows = tree.groupBy("host", "path", "parent", "kind", "n").agg(F.count(F.lit(1)).alias("times"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        entropy, recurrence = importance(pdf), importance(pdf, recurrence=True)
        low = {p: least_of for p, v in entropy.items() if (least_of := min(v, recurrence[p])) * MIXED < least}
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "paths": [list(low)], "importance": [list(low.values())]})

    return rows.groupBy("host").applyInPandas(judge, "host string, paths array<long>, importance array<double>").where(F.size("paths") > 0)


TEXTS = "page_id long, url string, text string, n_chars long, n_low long, n_repeated long"


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, names: bool = True) -> DataFrame:
    """Every row of pages (page_id, url, html; others ignored): page_id, url, text, n_chars, n_low (branches removed
    for low importance) and n_repeated (those of them that the tree's entropies alone would remove).

    Blocks are joined by line breaks in page order; white space inside a block is one space; a
    line break element is white space. Where a page has an article or main element, the text is what lies
    inside, unless what is left outside is more than LANDMARK_WEIGHT times as long; else, and then, the whole body counts.
    names=False leaves the decision to the entropies alone. Null or empty html gives an empty text; a null url has the
    host ''; repeated rows give repeated results; no rows give no rows."""
    common.long_texts(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    judged = common.written(site_importance(rows.withColumn("row", F.xxhash64("page_id", "url")), least), "site-importance")
    joined = rows.join(common.small(judged), "host", "left").select("page_id", "url", "paths", "importance", "html")

    def texts(batches):
        for batch in batches:
            out, last, low = [], None, {}
            for page_id, url, paths, values, source in zip(*(batch.column(k) for k in range(4)), batch.column(4)):
                if (paths := paths.as_py()) != last:
                    last, low = paths, dict(zip(paths or (), values.as_py() or ()))
                text, *counts = Page(source.as_py() or "").extracted(low, least, names)
                out.append((page_id.as_py(), url.as_py(), text, len(text), *counts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3))], names=["page_id", "url", "text", "n_chars", "n_low", "n_repeated"])

    return joined.mapInArrow(common.tidy(texts), TEXTS)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
