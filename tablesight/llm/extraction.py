"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between the borders of block elements,
in page order. The field labels each block as main text or not, from

  - its ancestors: tags, the words of their classes, ids and roles;
  - its text: words, share of links, punctuation, stock phrases;
  - the block before: four weights for the pair of labels, others if both
    blocks have the same container.

Weights maximize the conditional likelihood of labelled pages (bounded in
number, on the driver, in seconds), by forward and backward sums over all label
sequences. Decoding takes the best sequence, by Viterbi's method. Pages are
independent of each other: no shuffle, memory a small multiple of a page.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .page_layouts import labelled_pages
from .shared import byte_slices, column_bytes

#: Labelled pages used at most.
MAX_LABELLED = 5_000
#: Features must occur in so many labelled blocks, and words in so many.
MIN_SEEN, MIN_WORD = 3, 12
STEPS, RATE, PENALTY = 120, 0.1, 1e-3
#: First words of a block that are features.
LEAD_WORDS = 6
#: Ancestors whose features a worker remembers.
HELD_PATHS = 20_000

# Elements of HTML that end the line of text they stand in.
BLOCK = frozenset("""address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul
video audio canvas math map ins""".split())
# Elements whose content is never text of the page.
HIDDEN = frozenset("head noscript template svg math select object canvas audio video button map".split())
# Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the key ends an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
# Elements that such an end tag doesn't reach beyond.
SCOPE = frozenset("ul ol dl table select body".split())
# Elements that hold lines of their container.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption label legend option caption".split())

# Quotes count only as an attribute's value, and only if they are closed.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)> | <[!?/][^>]*+>""", re.S | re.X)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[^\W\d_]+")


class Element:
    """An open element: its tag, names, path of ancestors and label."""
    __slots__ = ("tag", "path", "hidden", "main", "key")

    def __init__(self, tag: str, attributes: str, parent: Element | None, key: int):
        names, self.main = "", parent.main if parent else 0
        if "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-main":
                    self.main = int(value == "1")
                else:
                    names += " " + value.lower()
        self.tag, self.key = tag, parent.key if tag in LINES else key
        self.path = (parent.path if parent else "") + "\n" + tag + names
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)


def leaf_blocks(html: str) -> list[tuple[str, str, int, float, int]]:
    """(text, path of ancestors, container, share of link characters, main) of
    each block that has text, in page order. Character references are decoded
    and white space is one space; comments, scripts and styles are left out."""
    out, parts, linked, in_link = [], [], 0, 0
    root = Element("#page", "", None, 0)
    stack, n_elements, at = [root], 0, 0

    def text(piece):
        nonlocal linked
        if "&" in piece:
            piece = unescape(piece)
        parts.append(piece)
        if in_link:
            linked += len(piece.strip())

    def end_block():
        nonlocal linked
        if parts:
            here = stack[-1]
            joined = " ".join("".join(parts).split())
            if joined and not here.hidden:
                out.append((joined, here.path, here.key, min(1.0, linked / len(joined)), here.main))
            parts.clear()
        linked = 0

    end = html.rfind(">") + 1
    while True:
        m = TOKEN.search(html, at, end)
        if not m:
            # What is left holds no whole tag; a tag that the page's end cuts is no text.
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
            text(rest[:cut.start()] if cut else rest)
            break
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW and not closing:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = found.end() if found else len(html)
            end = max(end, at)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK:
            end_block()
            if closing:
                if tag not in ("body", "html"):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            del stack[i:]
                            break
            else:
                closed = CLOSES.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p" or stack[i].tag in closed:
                        if i + 1 == len(stack) or stack[i].tag in closed:
                            del stack[i:]
                        if tag not in ("tr", "td", "th"):
                            break
                    elif stack[i].tag in SCOPE:
                        break
                if tag not in VOID:
                    n_elements += 1
                    stack.append(Element(tag, attributes, stack[-1], n_elements))
    end_block()
    return out


def path_features(path: str) -> list[str]:
    """Features of a block's ancestors."""
    out, before = set(), ""
    levels = [x.split(" ", 1) for x in path.split("\n")[2:]]
    for i, level in enumerate(levels):
        tag = level[0]
        out.add(f"in {tag}")
        names = [w for w in NAME.findall(level[1])] if len(level) > 1 else []
        out.update(f"named {w}" for w in names)
        if i == len(levels) - 1:
            out.add(f"is {tag}")
            out.add(f"step {before}>{tag}")
            out.update(f"is named {w}" for w in names)
        before = tag
    return sorted(out)


def text_features(text: str, links: float) -> list[str]:
    """Features of a block's own text."""
    words = text.split(" ")
    n = len(words)
    out = [f"words {n.bit_length()}", "links all" if links > .7 else "links many" if links > .3 else "links some" if links > 0 else "links none"]
    if text[-1] in ".!?…。\"”»:":
        out.append("ends sentence")
    if "," in text:
        out.append("comma")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text:
        out.append("divider")
    if sum(map(str.isdigit, text[:200])) > .3 * min(len(text), 200):
        out.append("digits")
    out += dict.fromkeys(f"word {w.strip('.,:;!?').lower()}" for w in words[:LEAD_WORDS] if len(w) <= 24)
    return out


class Field:
    """Weights: of features (for main against other), of label pairs by
    [same container][label before][label], of the first block's label. Plain
    values, as executors need not have this module."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, first: float):
        self.weights, self.pairs, self.first = weights, pairs.tolist(), first
        self.held = {}

    def path_weight(self, path: str) -> float:
        w = self.held.get(path)
        if w is None:
            if len(self.held) >= HELD_PATHS:
                self.held.clear()
            w = self.held[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return w

    def decode(self, blocks) -> list[int]:
        """Best label of each block: Viterbi's method over (other, main)."""
        if not blocks:
            return []
        get, back, container = self.weights.get, [], None
        other = main = 0.0
        for i, (text, path, key, links, _) in enumerate(blocks):
            own = self.path_weight(path) + sum(get(f, 0.0) for f in text_features(text, links))
            if i == 0:
                other, main = 0.0, self.first + own
            else:
                (oo, om), (mo, mm) = self.pairs[key == container]
                to_other, to_main = main + mo > other + oo, main + mm > other + om
                back.append((to_other, to_main))
                other, main = (main + mo if to_other else other + oo), (main + mm if to_main else other + om) + own
            container = key
        label = int(main > other)
        labels = [label]
        for to in reversed(back):
            label = int(to[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[str]) -> Field:
    """Fits the field to labelled pages: HTML in which ``data-main`` marks the
    elements that are main text (1) or not (0). Deterministic."""
    if len(pages) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled pages")
    pages = [b for b in map(leaf_blocks, pages) if b]
    named = [[path_features(path) + text_features(text, links) for text, path, _, links, _ in blocks] for blocks in pages]
    seen = {}
    for f in (f for page in named for block in page for f in block):
        seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= (MIN_WORD if f.startswith("word ") else MIN_SEEN)))}
    n_pages, longest = len(pages), max(map(len, pages), default=1)
    # Position by page; pages shorter than the longest are followed by nothing.
    label = np.zeros((longest, n_pages), np.int64)
    same = np.zeros((longest, n_pages), np.int64)
    valid = np.zeros((longest, n_pages), bool)
    feature, where = [], []
    for p, (blocks, names) in enumerate(zip(pages, named)):
        for i, (block, of) in enumerate(zip(blocks, names)):
            label[i, p], valid[i, p] = block[4], True
            same[i, p] = i > 0 and block[2] == blocks[i - 1][2]
            ids = [index[f] for f in of if f in index]
            feature += ids
            where += [i * n_pages + p] * len(ids)
    feature, where = np.array(feature, np.int64), np.array(where, np.int64)
    n = len(index)
    theta = np.zeros(n + 9)
    # How often each (same container, label before, label) occurs.
    kind = same[1:] * 4 + label[:-1] * 2 + label[1:]
    seen_pairs = np.bincount(kind[valid[1:]], minlength=8)

    def gradient(theta):
        weight, pairs, first = theta[:n], theta[n:n + 8].reshape(2, 2, 2), theta[-1]
        own = np.bincount(where, weights=weight[feature], minlength=n_pages * longest).reshape(longest, n_pages)
        own[0] += first
        p = 1 / (1 + np.exp(-np.clip(own, -500, 500)))
        emit = np.stack([1 - p, p], -1) + 1e-300
        step = np.exp(pairs)[same]
        # Forward and backward sums, scaled at each position.
        ahead, behind = np.zeros_like(emit), np.ones_like(emit)
        ahead[0] = emit[0]
        for i in range(1, longest):
            x = np.einsum("pa,pab->pb", ahead[i - 1], step[i]) * emit[i]
            ahead[i] = x / x.sum(1, keepdims=True)
        for i in range(longest - 2, -1, -1):
            x = np.einsum("pab,pb->pa", step[i + 1], emit[i + 1] * behind[i + 1])
            behind[i] = np.where(valid[i + 1, :, None], x / x.sum(1, keepdims=True), 1)
        both = ahead * behind
        wrong = np.where(valid, label - both[..., 1] / both.sum(-1), 0)
        joint = ahead[:-1, :, :, None] * step[1:] * (emit[1:] * behind[1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = [joint[valid[1:] & (same[1:] == k)].sum(0) for k in (0, 1)]
        out = np.empty_like(theta)
        out[:n] = np.bincount(feature, weights=wrong.ravel()[where], minlength=n)
        out[n:n + 8] = seen_pairs - np.ravel(expected)
        out[-1] = wrong[0].sum()
        return out / max(n_pages, 1) - PENALTY * theta

    # Adam's steps over the whole set.
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        g = gradient(theta)
        m, v = .9 * m + .1 * g, .99 * v + .01 * g * g
        theta += RATE * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .99 ** t)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in index.items()}, theta[n:n + 8].reshape(2, 2, 2), float(theta[-1]))


OUTPUT = ["text", "n_chars", "n_blocks", "n_main"]


def extract(pages: DataFrame, columns: list[str], html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """One row per row of ``pages``: ``columns`` of it, text (main blocks joined
    by line ends), n_chars (its code points), n_blocks, n_main.

    ``labelled`` pages train the field; by default those of ``page_layouts``.
    Null, empty and textless pages give an empty text, as does a page without
    main text. Repeated pages give repeated results. Bytes that aren't UTF-8
    become U+FFFD. A cut page ends where it ends: an unfinished tag, script or
    comment is no text. Other columns, whatever their names, are ignored; those
    named in ``columns`` must not be called like the results.
    """
    if set(columns) & set(OUTPUT):
        raise ValueError(f"kept columns must not be called {OUTPUT}")
    field = train(labelled_pages() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.pairs, field.first))
    inner = [f"c{i}" for i in range(len(columns))]
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), *(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner)))

    def run(batches):
        weights, pairs, first = shared.value
        field = Field(weights, np.array(pairs), first)
        for batch in byte_slices(batches):
            texts, counts = [], []
            for html in column_bytes(batch.column(0)):
                blocks = leaf_blocks(html.decode("utf-8", "replace"))
                labels = field.decode(blocks)
                texts.append("\n".join(b[0] for b, y in zip(blocks, labels) if y))
                counts.append((len(texts[-1]), len(blocks), sum(labels)))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), *(pa.array(counts[:, i]) for i in range(3))], [*inner, *OUTPUT])

    made = T.StructType.fromDDL("text string, n_chars long, n_blocks long, n_main long")
    schema = T.StructType([*rows.select(inner).schema, *made])
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(inner, columns)))
