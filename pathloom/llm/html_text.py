"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, with the tags and
class names above them.  Each block gets features of its ancestors and of its text, and
the two-state chain (main or not) over the page's blocks is decoded by Viterbi.  The
weights are trained by maximum likelihood with the forward and backward recursions on
labelled pages; training pages are a bounded set and the weights are broadcast.

Scripts, styles, titles, comments, drawings and the content of text fields hold no text.  Character references
are decoded, white space inside a block becomes one blank, and the main blocks are joined
in page order by empty lines.  Nothing else is dropped or capped.

Defined results: null and empty pages, and pages without main blocks, have an empty text;
markup nested to any depth is read in
time in proportion to the page; broken markup is read as far as it goes (an open quote or comment ends with the page);
repeated rows are read one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.labelled_pages import MARK, pages
from pathloom.llm.optimise import minimise

# Element names of the HTML standard, by how the reader treats them.
RAW = frozenset("script style noscript template iframe svg textarea title".split())
#: Of these the first may close itself, and both may hold others of their kind.
FOREIGN, NESTED = "svg", ("svg", "template")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that any page has, whether it says so or not.
IMPLIED = ("html", "body")
CLOSES_P = BLOCK - frozenset("body head html button label option td th tr".split())
#: A start tag that ends an open element of the same kind beside it.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
OPEN = re.compile(r"<(?=[A-Za-z/!?])")
NAMED = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*("[^"]*+"|'[^']*+'|[^\s>"']+)""")
LETTERS = re.compile("[a-z]+")


class _Element:
    """An open element.  What its blocks inherit is worked out once, from its parent."""

    __slots__ = ("features", "leaf", "main", "tag")

    def __init__(self, parent: "_Element | None", tag: str, names: tuple[str, ...], main: bool, known: Container[str] | None) -> None:
        new = {f"named {n}" for n in names}
        if tag not in IMPLIED:
            new.add(f"in {tag}")
        if known is not None:
            new = {f for f in new if f in known}
        if parent is not None:
            new -= parent.features
        above = parent.features if parent is not None else frozenset()
        self.tag = tag
        self.features: frozenset[str] = above | new if new else above
        self.leaf: str = tag if tag in BLOCK and tag not in IMPLIED else parent.leaf if parent is not None else ""
        self.main: bool = main or (parent is not None and parent.main)


class Block(NamedTuple):
    text: str
    leaf: str
    inherited: frozenset[str]
    linked: int
    main: bool


class _Stack:
    """The open elements, and where those of each kind stand."""

    def __init__(self, known: Container[str] | None) -> None:
        self.known = known
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> _Element | None:
        return self.open[-1] if self.open else None

    def last(self, kinds: tuple[str, ...]) -> int:
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)

    def push(self, tag: str, names: tuple[str, ...], main: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Element(self.top(), tag, names, main, self.known))

    def pop_to(self, place: int) -> bool:
        """Closes the element at a place and all in it; tells if any of them is a block."""
        block = False
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.places[tag].pop()
            block = block or tag in BLOCK
        return block


def _after(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of an element that holds no text, or the page's end."""
    depth = 1
    for m in re.compile(rf"(?i)<(/?){re.escape(tag)}(?![\w-])[^>]*>").finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in NESTED and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page, in order; of what they inherit, only features in ``known`` (None: all)."""
    stack = _Stack(known)
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            linked = sum(len(p.strip()) for p, link in pieces if link)
            top = stack.top()
            out.append(
                Block(text, top.leaf, top.features, linked, top.main) if top is not None else Block(text, "", frozenset(), linked, False)
            )
        pieces.clear()

    def close(kinds: tuple[str, ...], limits: tuple[str, ...] = ()) -> None:
        place = stack.last(kinds)
        if place < 0 or place < stack.last(limits):
            return
        if any(e.tag in BLOCK for e in stack.open[place:]):
            flush()
        stack.pop_to(place)

    at, end = 0, len(page)
    while at < end:
        m = OPEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append((page[at:stop], bool(stack.places.get("a"))))
        if not m:
            break
        if page.startswith("<!--", stop):
            ends = page.find("-->", stop + 4)
            at = end if ends < 0 else ends + 3
            continue
        if page[stop + 1] in "!?":
            ends = page.find(">", stop)
            at = end if ends < 0 else ends + 1
            continue
        t = TAG.match(page, stop)
        if not t:
            # A stray sign, or a tag that the page's end cuts off.
            if page.find(">", stop) < 0:
                break
            pieces.append(("<", False))
            at = stop + 1
            continue
        at, tag = t.end(), t[2].lower()
        if t[1]:
            close((tag,), ("table",) if tag not in ("table", "body", "html") else ())
            continue
        if tag in RAW:
            if tag != FOREIGN or not t[3].endswith("/"):
                at = _after(page, tag, at)
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "button"))
        if tag in SAME:
            close(SAME[tag], LIMITS[tag])
        if tag in BLOCK:
            flush()
        if tag not in VOID:
            names = tuple(w for n in NAMED.findall(t[3]) for w in LETTERS.findall(n.lower())) if t[3] else ()
            stack.push(tag, names, MARK in t[3])
    flush()
    return out


def _features(found: list[Block]) -> list[list[str]]:
    """Of each block, what is known of its ancestors and text."""
    out = []
    for k, b in enumerate(found):
        n = len(b.text)
        share = b.linked / max(n, 1)
        f = ["bias", f"leaf {b.leaf}", f"size {min(n.bit_length(), 11)}", f"links {min(int(share * 4), 4)}", *b.inherited]
        if b.text[-1] in ".!?:;…\"'”»":
            f.append("stop")
        if b.text[0] == "©":
            f.append("rights")
        if k == 0:
            f.append("first")
        if k == len(found) - 1:
            f.append("last")
        out.append(f)
    return out


class Chain(NamedTuple):
    """Weights of the main state against the other, and of the moves between states."""

    weights: dict[str, float]
    moves: np.ndarray

    def decode(self, features: list[list[str]]) -> list[bool]:
        """Viterbi over two states; a tie is not main."""
        get = self.weights.get
        stay0, to1, to0, stay1 = self.moves.ravel().tolist()
        s0, s1 = 0.0, 0.0
        back: list[tuple[bool, bool]] = []
        for k, f in enumerate(features):
            u = sum(get(x, 0.0) for x in f)
            if k == 0:
                s0, s1 = 0.0, u
                continue
            from0, from1 = s1 + to0 > s0 + stay0, s1 + stay1 > s0 + to1
            back.append((from0, from1))
            s0, s1 = max(s0 + stay0, s1 + to0), max(s0 + to1, s1 + stay1) + u
        if not features:
            return []
        state = s1 > s0
        out = [state]
        for from0, from1 in reversed(back):
            state = from1 if state else from0
            out.append(state)
        return out[::-1]


def train(labelled: list[str], ridge: float = 0.5, steps: int = 60) -> Chain:
    """Maximum likelihood on pages whose main blocks are marked."""
    seen = [blocks(p) for p in labelled]
    seen = [s for s in seen if s]
    names: dict[str, int] = {}
    length = max(map(len, seen))
    rows, columns, y = [], [], np.zeros((len(seen), length), dtype=np.int64)
    for i, found in enumerate(seen):
        for k, f in enumerate(_features(found)):
            for x in f:
                rows.append(i * length + k)
                columns.append(names.setdefault(x, len(names)))
            y[i, k] = found[k].main
    rows, columns = np.array(rows), np.array(columns)
    live = np.arange(length)[None, :] < np.array([len(s) for s in seen])[:, None]
    width = len(names)
    observed_moves = np.zeros((2, 2))
    both = live[:, 1:]
    np.add.at(observed_moves, (y[:, :-1][both], y[:, 1:][both]), 1)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        u = np.bincount(rows, weights=w[columns], minlength=live.size).reshape(live.shape)
        scores = np.stack((np.zeros_like(u), u), axis=-1)
        moves = w[width:].reshape(2, 2)
        alpha = np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, length):
            step = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + scores[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros_like(scores)
        expected_moves = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            ahead = scores[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
            joint = np.exp(alpha[:, t, :, None] + moves + ahead[:, None, :] - total[:, None, None])
            expected_moves += (joint * live[:, t + 1, None, None]).sum(0)
        p = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * live
        gold = (u * y * live).sum() + (moves * observed_moves).sum()
        pull = (p - y * live).ravel()
        g = np.concatenate((np.bincount(columns, weights=pull[rows], minlength=width), (expected_moves - observed_moves).ravel()))
        return total.sum() - gold + 0.5 * ridge * (w @ w), g + ridge * w

    w = minimise(objective, np.zeros(width + 4), steps)
    return Chain({n: float(w[i]) for n, i in names.items()}, w[width:].reshape(2, 2))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "", chain.weights)
    keep = chain.decode(_features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(
    table: DataFrame, *, id: str = "page_id", url: str = "url", page: str = "html", chain: Chain | None = None
) -> DataFrame:
    """``id``, ``url``, text and n_chars of every page."""
    shared = table.sparkSession.sparkContext.broadcast(chain or train(pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "page"):
                texts = [main_text(p, shared.value) for p in piece.column(2).to_pylist()]
                yield pa.record_batch(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    rows = table.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).alias("page"))
    out = rows.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", "n_chars")
