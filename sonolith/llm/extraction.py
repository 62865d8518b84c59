"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element and each run of text is a variable with three states: boilerplate,
container, content. Potentials of a node come from its tag, the words of its class, id and
role, its share of linked text and its length; potentials of a parent and its child are
one table for each kind of child: text, plain block, other element. Sum-product messages pass from the leaves to the root and back, which gives
exact marginals on a tree. The weights maximise the likelihood of labelled pages, by the
same messages. A page's text is that of the runs that are more likely content than not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonolith.llm.html_pages import pages
from sonolith.llm.html_tree import Node, parse

STATES = ("b", "n", "c")
CONTENT = STATES.index("c")

# Parts of class, id and role names that tell boilerplate, and content.
BOILERPLATE = "nav navigation menu foot footer head header side sidebar bar ad ads adv advert advertisement banner promo promotion sponsor sponsored cookie cookies consent notice alert newsletter subscribe signup share sharing social related recommended comment comments reply replies respond disqus breadcrumb breadcrumbs pagination pager widget popup modal login search copyright legal complementary contentinfo toolbar tags skip".split()
MAIN = "article content post entry story body main text page".split()
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=4096)
def _cues(names: str) -> tuple[str, ...]:
    words = set(_WORDS.findall(_CAMEL.sub(" ", names).lower()))
    return tuple(["cue=b"] * bool(words & set(BOILERPLATE)) + ["cue=c"] * bool(words & set(MAIN) and not words & set(BOILERPLATE)))


def node_features(n: Node, parent_tag: str) -> list[str]:
    size = "len=%d" % min(6, (n.chars // 20).bit_length())
    share = n.linked / n.chars if n.chars else 0.0
    links = "links=%d" % (0 if share < 0.05 else 1 if share < 0.5 else 2)
    if n.tag == "#text":
        return ["text", f"in={parent_tag}", f"text {size}", f"text {links}"] + ["stop"] * (n.text[-1] in ".!?:;…\"")
    out = [f"tag={n.tag}", links]
    if n.attrs:
        out += _cues(" ".join(n.attrs.get(k, "") for k in ("class", "id", "role")))
    return out


#: Blocks that say nothing of their own, if they have no telling class, id or role.
PLAIN = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tr td th figure figcaption".split())
KINDS = 3


def kind(n: Node, features: list[str]) -> int:
    return 0 if n.tag == "#text" else 1 if n.tag in PLAIN and not any(f.startswith("cue") for f in features) else 2


@dataclass
class Forest:
    """Nodes of several pages: parents (-1: a root), kinds, levels from the roots, and features."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    owner: np.ndarray  # node of each feature
    feature: np.ndarray


def forest(trees: list[list[Node]], names: dict[str, int], grow: bool = False) -> Forest:
    parent, kinds, depth, owner, feature = [], [], [], [], []
    for nodes in trees:
        base = len(parent)
        for k, n in enumerate(nodes):
            parent.append(n.parent + base if n.parent >= 0 else -1)
            depth.append(n.depth)
            features = node_features(n, nodes[n.parent].tag if n.parent >= 0 else "")
            kinds.append(kind(n, features))
            for f in features:
                i = names.setdefault(f, len(names)) if grow else names.get(f, -1)
                if i >= 0:
                    owner.append(base + k)
                    feature.append(i)
    depths = np.array(depth)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1)
    return Forest(np.array(parent), np.array(kinds), levels, np.array(owner, dtype=np.int64), np.array(feature, dtype=np.int64))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Model:
    names: dict[str, int]
    unary: np.ndarray  # features x states
    pair: np.ndarray  # kind of child x parent's state x child's

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Of each node, and of each node with its parent (parent's state x own)."""
        n, k = len(f.parent), len(STATES)
        below = np.zeros((n, k))
        np.add.at(below, f.owner, self.unary[f.feature])
        up = np.zeros((n, k))  # message to the parent
        for level in reversed(f.levels[1:]):
            up[level] = _log_sum(self.pair[f.kind[level]] + below[level][:, None, :], axis=2)
            np.add.at(below, f.parent[level], up[level])
        belief = below.copy()
        both = np.zeros((n, k, k))
        for level in f.levels[1:]:
            p = f.parent[level]
            rest = (belief[p] - up[level])[:, :, None] + self.pair[f.kind[level]]
            belief[level] += _log_sum(rest, axis=1)
            both[level] = rest + below[level][:, None, :]
        prob = np.exp(belief - _log_sum(belief, axis=1)[:, None])
        flat = both.reshape(n, k * k)
        pairs = np.exp(flat - _log_sum(flat, axis=1)[:, None]).reshape(n, k, k)
        return prob, pairs


def labels(nodes: list[Node]) -> list[int]:
    """A label holds for what is below, up to the next one."""
    out: list[int] = []
    for n in nodes:
        out.append(STATES.index(n.label) if n.label else out[n.parent] if n.parent >= 0 else STATES.index("n"))
    return out


def train(labelled: list[str], steps: int = 500, rate: float = 0.05, ridge: float = 0.001) -> Model:
    """Maximum likelihood (with a ridge) by Adam steps on exact expectations."""
    trees = [parse(p) for p in labelled]
    names: dict[str, int] = {}
    f = forest(trees, names, grow=True)
    truth = np.eye(len(STATES))[[s for t in trees for s in labels(t)]]
    child = np.flatnonzero(f.parent >= 0)
    of_kind = np.eye(KINDS)[f.kind[child]]
    seen = np.einsum("nk,ni,nj->kij", of_kind, truth[f.parent[child]], truth[child])
    m = Model(names, np.zeros((len(names), len(STATES))), np.zeros((KINDS, len(STATES), len(STATES))))
    mean, square = ([np.zeros_like(m.unary), np.zeros_like(m.pair)] for _ in range(2))
    for t in range(1, steps + 1):
        prob, pairs = m.marginals(f)
        grads = [np.zeros_like(m.unary), seen - np.einsum("nk,nij->kij", of_kind, pairs[child])]
        np.add.at(grads[0], f.feature, (truth - prob)[f.owner])
        for w, g, v1, v2 in zip((m.unary, m.pair), grads, mean, square, strict=True):
            g -= ridge * len(labelled) * w
            v1 += 0.1 * (g - v1)
            v2 += 0.01 * (g * g - v2)
            w += rate * (v1 / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.99**t)) + 1e-8)
    return m


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(pages())


def main_texts(htmls: list[str], model: Model) -> list[str]:
    trees = [parse(h) for h in htmls]
    f = forest(trees, model.names)
    content = model.marginals(f)[0][:, CONTENT] > 0.5
    out, at = [], 0
    for nodes in trees:
        out.append("\n\n".join(n.text for k, n in enumerate(nodes, at) if n.tag == "#text" and content[k]))
        at += len(nodes)
    return out


def extract(docs: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """Main text of every page: the columns ``keep``, text, n_chars (code points).

    Blocks are joined in page order by two line breaks; white space inside a block is one
    space; character references are decoded. Null and empty pages and pages without content
    have an empty text. Any column but ``html`` may be null; other columns are ignored.
    Repeated rows get equal results. An empty table gives no rows.
    """
    model = model or default_model()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            part: list[str] = []
            for h in b.column(html).to_pylist():
                part.append(h or "")
                if sum(map(len, part)) > 1 << 20 or len(part) >= 256:
                    texts += main_texts(part, model)
                    part = []
            if part:
                texts += main_texts(part, model)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, html).mapInArrow(apply, f"{types}, text string, n_chars long")
