"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label: its own text is content or not.  The
model gives each child's label given its parent's (by tag) and the node's features given
its label (tag, class and id words, link share, length, punctuation, position), all as
smoothed counts.  Messages go up from the leaves and down from the root (sum-product) and
give each node's exact marginal; text of nodes above one half is kept in page order.

Labelled pages: those of the table that mark their content by ``article`` or ``main`` teach
by it (about ``sample`` pages, drawn by a hash of the page), with built-in labelled
layouts, made from a rule, for parts that a table may not show.  Counting runs on Spark;
the model is at most ``features`` counts.

Defined results: null and empty html give an empty text and n_chars 0; broken markup is
closed as far as needed; text in script, style, head and the like never counts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm.common import text_batches

# fixed values: element names
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("script style textarea title xmp iframe noembed noframes noscript template head svg math select option button object".split())
CLOSES = {  # opening one of these ends an open element of that name
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote fieldset figure".split())
# fixed values: words in class, id or role of parts that are not content
APART = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social footer header masthead toolbar pagination pager "
    "comment comments reply replies respond discussion disqus form search login complementary contentinfo".split()
)
MAIN = frozenset("content article post entry story main body text prose".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""", re.S)  # a tag with an open quote ends at the next >
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset = frozenset()
    unseen: bool = False
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    order: int = 0
    blocks: list = field(default_factory=list)


@dataclass(frozen=True)
class TreeModel:
    sample: int = 2000
    features: int = 20_000
    rare: int = 3
    smooth: float = 0.5
    temper: float = 0.3


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents first, and text blocks (node, text) in page order."""
    nodes, blocks = [Node("#page", -1)], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones stand for their block
    pieces: list[str] = []

    def flush(owner: int) -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            blocks.append((owner, text))
            nodes[owner].chars += len(text)
            nodes[owner].stops += sum(text.count(c) for c in ".,;!?")

    def close_to(depth: int) -> None:
        if any(tag not in INLINE for tag, _ in stack[depth:]):
            flush(stack[-1][1])
        del stack[depth:]

    def last_open(names, barrier=frozenset()) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in barrier:
                break
        return 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            text = entities.unescape(text)
            pieces.append(text)
            if any(tag == "a" for tag, _ in stack):
                nodes[stack[-1][1]].link_chars += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not m[0].endswith(">"):
            break  # the page ends inside a tag
        if closing:
            depth = last_open((tag,), () if tag in ENDS_P or tag in ("body", "html") else SCOPE - {tag})
            if depth:
                close_to(depth)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush(stack[-1][1])
            continue
        if tag in ENDS_P and (depth := last_open(("p",), SCOPE)):
            close_to(depth)
        if tag in CLOSES and (depth := last_open(CLOSES[tag], SCOPE - set(CLOSES[tag]))):
            close_to(depth)
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
        else:
            flush(stack[-1][1])
            names, hidden = set(), False
            for a in _ATTR.finditer(m[3] or ""):
                names.update(w.lower() for w in _WORD.findall(a[2] or ""))
                hidden |= a[1].lower() == "hidden" or (a[1].lower() == "aria-hidden" and "true" in (a[2] or ""))
            owner = stack[-1][1]
            nodes.append(Node(tag, owner, frozenset(names), nodes[owner].unseen or tag in UNSEEN or hidden, order=len(nodes)))
            if not (m[3] or "").endswith("/") or tag not in ("svg", "math"):
                stack.append((tag, len(nodes) - 1))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if stack[-1][0] == tag:
                del stack[-1]
    flush(stack[-1][1])
    return nodes, blocks


def _bucket(x: float) -> int:
    return int(math.log2(x + 1))


def features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    share = n.link_chars / n.chars if n.chars else 0.0
    parent = nodes[n.parent].tag if n.parent >= 0 else ""
    out = [f"under {parent} {n.tag}", f"links {min(3, int(share * 4))}", f"length {min(9, _bucket(n.chars))}", f"stops {min(4, _bucket(n.stops))}"]
    out += [f"name {w}" for w in n.names]
    if n.names & APART:
        out.append("named apart")
    elif n.names & MAIN:
        out.append("named main")
    return out


def marked_content(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks its content; None for other pages."""
    roots = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if not roots:
        return None
    labels = [0] * len(nodes)
    for i, n in enumerate(nodes):
        apart = n.tag in ("nav", "aside", "footer", "form", "header") or n.names & APART or n.unseen
        inside = i in roots or (n.parent >= 0 and labels[n.parent] == 1)
        labels[i] = int(bool(inside and not apart))
    return labels


def layouts() -> list[str]:
    """Built-in labelled pages: every kind of part around and inside a marked article."""
    words = "the main part of this page tells its story in whole sentences, one after the other, with commas and stops."
    apart = [f"<{t}><p>{words[:k]}</p><ul><li><a href='x'>more</a></li></ul></{t}>" for t in ("nav", "aside", "footer", "header", "form") for k in (20, 60)]
    apart += [f'<{t} class="{w}"><p>{words[:k]}</p><div>{words[:30]}</div></{t}>' for w in sorted(APART) for t, k in (("div", 40), ("section", 70))]
    out = []
    for k, part in enumerate(apart):
        other = apart[(7 * k + 3) % len(apart)]
        name = sorted(MAIN)[k % len(MAIN)]
        body = f'<h1>A title of the page</h1><p>{words}</p><h2>Next</h2><p>{words} {words}</p><div class="{name}"><p>{words}</p></div><blockquote><p>{words}</p></blockquote><ul><li>{words}</li></ul>'
        out.append(f'<html><body>{other}<main><article class="{name}">{body}{part}</article></main>{part}</body></html>')
        out.append(f'<html><body><div class="page"><div class="{name}"><article>{body}</article></div>{part}</div>{other}</body></html>')
        out.append(f'<html><body>{other}<main>{body}<section><h2>Part</h2><p>{words}</p></section>{part}</main></body></html>')
    return out


def _counts(nodes: list[Node], labels: list[int], into: Counter, drop_marks: bool) -> None:
    """Counts of one labelled page; ``drop_marks`` renames the marking elements to div."""
    for i, n in enumerate(nodes):
        if n.unseen:
            continue
        y, up = labels[i], labels[n.parent] if n.parent >= 0 else 0
        if drop_marks and n.tag in ("article", "main"):
            n.tag = "div"
        into["step", n.tag, up, y] += 1
        into["step", "", up, y] += 1
        into["all", "", 0, y] += 1
        for f in features(nodes, i):
            into["seen", f, 0, y] += 1


def learn(pages: DataFrame, plan: TreeModel = TreeModel()) -> dict:
    """Log potentials: of features per label, and of a child's label per tag and parent's label."""
    marked = pages.where("html IS NOT NULL").select(F.col("html").cast("string").alias("html"))
    total = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < float(1 << 30) * plan.sample / max(total, 1)).repartition(16)

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                for drop in (False, True):
                    nodes, _ = parse(page.as_py())
                    labels = marked_content(nodes)
                    if labels:
                        _counts(nodes, labels, found, drop)
        if found:
            yield pa.RecordBatch.from_pylist([{"kind": k, "name": n, "up": u, "y": y, "c": c} for (k, n, u, y), c in sorted(found.items())])

    summed = drawn.mapInArrow(count, "kind string, name string, up bigint, y bigint, c bigint").groupBy("kind", "name", "up", "y").agg(F.sum("c").alias("c"))
    kept = summed.where((F.col("kind") != "seen") | (F.col("c") >= plan.rare)).orderBy(F.desc("c"), "kind", "name", "up", "y").limit(plan.features).collect()
    counts: Counter = Counter({(r.kind, r.name, r.up, r.y): r.c for r in kept})
    built_in: Counter = Counter()
    for page in layouts():
        for drop in (False, True):
            nodes, _ = parse(page)
            _counts(nodes, marked_content(nodes), built_in, drop)
    # the layouts weigh as much as the drawn pages, and once at least
    weight = max(1.0, counts["all", "", 0, 0] / max(1, built_in["all", "", 0, 0]))
    for k, c in built_in.items():
        counts[k] += c * weight
    s = plan.smooth
    label = [counts["all", "", 0, y] + 2 * s for y in (0, 1)]
    names = {k[1] for k in counts if k[0] == "seen"}
    seen = {n: tuple(math.log((counts["seen", n, 0, y] + s) / label[y]) for y in (0, 1)) for n in names}
    step = {}
    for tag in {k[1] for k in counts if k[0] == "step"}:
        rows = []
        for up in (0, 1):
            both = [counts["step", tag, up, y] + 4 * s * (counts["step", "", up, y] + s) / (counts["step", "", up, 0] + counts["step", "", up, 1] + 2 * s) for y in (0, 1)]
            rows.append(tuple(math.log(b / sum(both)) for b in both))
        step[tag] = tuple(rows)
    return {"seen": seen, "step": step, "temper": plan.temper}


def _log_sum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Probability that each node's own text is content, by sum-product on the tree."""
    n, never = len(nodes), -1e9
    seen, step = model["seen"], model["step"]
    up = []
    for i, node in enumerate(nodes):
        if node.unseen:
            up.append([0.0, never])
            continue
        zero = one = 0.0
        for f in features(nodes, i):
            a, b = seen.get(f, (0.0, 0.0))
            # features depend on each other, so all but the names count in part
            part = 1.0 if f.startswith("name") else model["temper"]
            zero += part * a
            one += part * b
        up.append([zero, one])
    sent: list = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        table = step.get(nodes[i].tag) or step[""]
        sent[i] = tuple(_log_sum(up[i][0] + table[p][0], up[i][1] + table[p][1]) for p in (0, 1))
        own = up[nodes[i].parent]
        own[0] += sent[i][0]
        own[1] += sent[i][1]
    down: list = [(0.0, 0.0)] * n
    out = [0.0] * n
    for i in range(n):
        if i:
            p = nodes[i].parent
            table = step.get(nodes[i].tag) or step[""]
            from_parent = [down[p][y] + up[p][y] - sent[i][y] for y in (0, 1)]
            down[i] = tuple(_log_sum(from_parent[0] + table[0][y], from_parent[1] + table[1][y]) for y in (0, 1))
        zero, one = down[i][0] + up[i][0], down[i][1] + up[i][1]
        out[i] = math.exp(one - _log_sum(zero, one))
    return out


def main_text(page: str | None, model: dict) -> str:
    nodes, blocks = parse(page or "")
    content = marginals(nodes, model)
    return " ".join(text for owner, text in blocks if content[owner] > 0.5)


def extract(pages: DataFrame, plan: TreeModel = TreeModel(), model: dict | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(pages, plan))
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), shared.value) for p in batch.column("html_")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
            )

    return text_batches(pages).select("page_id", "url", F.col("html").cast("string").alias("html_")).mapInArrow(run, schema)
