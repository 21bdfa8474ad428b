"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi.

A block's features are the tags and the class and id words of its ancestors, and forms of its text: length, share of linked
signs, closing mark, capital letters, copyright signs, whether it is the last, and the shares of the page's prose that its part of the
page and the parts beside it hold. The weights are fitted by the conditional
likelihood on labelled pages of many layouts (labelled_pages.page for PAGES seeds). `python -m loomgrid.llm.html_crf` fits them
and writes them to WEIGHTS beside this file, from where they are read and sent to the tasks; their number is fixed by the
feature buckets.

Null and empty pages, and pages without article text, have the empty text. Whole pages are read, however long and however
deep they are nested; every row gives one row, repeated rows and null ids too; other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.dom import Block, Element, blocks
from loomgrid.llm.labelled_pages import LAYOUTS, page

BUCKETS = 1 << 13
STIFF = 1_000  # times that steps from label to label are held back more than features, so that a lone block between others can stand
NAMES = 1 << 11  # words of ancestors that are told apart, so that no block has more features of them, however deep it stands
PAGES = 720
ROUNDS = 200
WARM = 10  # rounds in which the steps grow to their full size, as the spread of a slope is not known before
OTHER, ARTICLE = 0, 1
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_crf.npz")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


SIGNS = ("article", "main", "nav", "aside", "footer", "header", "form", "table")
_SIGN = {t: (_bucket(f"in={t}"), _bucket(f"no {t}")) for t in SIGNS}


@lru_cache(maxsize=100_000)
def _named(kind: str, name: str) -> int:
    return _bucket(f"{kind}={zlib.crc32(name.encode()) % NAMES if kind == 'word' else name}")


def _told(element: Element) -> tuple[frozenset, tuple[int, ...], frozenset]:
    """The buckets that an element and those around it are told by, for the elements inside it, and all features of its path."""
    chain = []
    while element.memo is None:
        chain.append(element)
        if element.parent is None:
            break
        element = element.parent
    for element in reversed(chain):
        tags: frozenset = frozenset()
        around: frozenset = frozenset()
        if element.parent is not None:
            above, tags = element.parent.memo[0], element.parent.memo[2]
            own = {_named("in", element.tag), *(_named("word", w) for w in element.words)}
            around = above if own <= above else above | own  # at most as many as there are buckets
            tags = tags if element.tag in tags or element.tag not in _SIGN else tags | {element.tag}
        told = {_named("own word", w) for w in element.words}
        told.add(_named("own", element.tag or "-"))
        told.add(_named("parents", f"{element.parent.tag if element.parent else ''}/{element.tag}"))
        told |= {no if t not in tags else _named(t, element.tag) for t, (_, no) in _SIGN.items()}
        element.memo = (around, (_BIAS, *sorted(around | told)), tags)
    return element.memo


_BIAS = _bucket("bias")


def _step(n: float, steps: tuple) -> int:
    return sum(n >= s for s in steps)


@lru_cache(maxsize=50_000)
def _of_form(form: tuple) -> tuple[int, ...]:
    return tuple(_bucket(f"{k}={v}") for k, v in enumerate(form)) + (_bucket(f"form={form[0]},{form[1]},{form[2]}"), _bucket(f"share={form[6]},{form[7]},{form[0]}"))


SHARES = (0.05, 0.2, 0.4, 0.7)


def features(block: Block, at: int, n: int) -> tuple[int, ...]:
    text = block.text
    size = len(text)
    form = (_step(size, (6, 15, 30, 60, 120, 250, 600)), _step(block.linked / size, (0.05, 0.3, 0.6, 0.9)), text[-1] if text[-1] in ".!?…:,;|" else "-", text[0].isupper(), "©" in text[:40], 0 < at == n - 1, _step(block.share, SHARES), _step(block.around, SHARES))
    return _told(block.inside)[1] + _of_form(form)


class Crf:
    """Weights of two labels: state (bucket x label) and transition (label x label)."""

    def __init__(self, state: np.ndarray, move: np.ndarray):
        self.state, self.move = state, move

    def scores(self, page_features: list[tuple[int, ...]]) -> np.ndarray:
        sizes = np.fromiter(map(len, page_features), dtype=np.int64, count=len(page_features))
        flat = np.fromiter((f for fs in page_features for f in fs), dtype=np.int64, count=int(sizes.sum()))
        return np.add.reduceat(self.state[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)

    def decode(self, page_features: list[tuple[int, ...]]) -> list[int]:
        """Viterbi; of equal paths the one with OTHER first."""
        if not page_features:
            return []
        (oo, oa), (ao, aa) = self.move.tolist()
        back: list[tuple[int, int]] = []
        o, a = 0.0, 0.0
        for k, (so, sa) in enumerate(self.scores(page_features).tolist()):
            if not k:
                o, a = so, sa
                continue
            to_o, to_a = (0, 1)[a + ao > o + oo], (0, 1)[a + aa > o + oa]
            o, a = (so + ((a + ao) if to_o else (o + oo))), (sa + ((a + aa) if to_a else (o + oa)))
            back.append((to_o, to_a))
        label = int(a > o)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(a - most).sum(axis=axis, keepdims=True))).squeeze(axis)


class Momentum:
    """Running means of a slope and of its square."""

    def __init__(self, like: np.ndarray):
        self.mean, self.square, self.n = np.zeros_like(like), np.zeros_like(like), 0

    def step(self, slope: np.ndarray) -> np.ndarray:
        self.n += 1
        self.mean += 0.1 * (slope - self.mean)
        self.square += 0.01 * (slope**2 - self.square)
        return self.mean / (1 - 0.9**self.n) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-9)


def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = ROUNDS, decay: float = 1e-4, rate: float = 0.1) -> Crf:
    """Maximises the conditional log likelihood by steps along the mean slope, scaled by its spread, that grow smaller to the
    end; all pages at once, padded to the longest."""
    pages = [p for p in pages if p[0]]
    state, move = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
    if not pages:
        return Crf(state, move)
    n, t = len(pages), max(len(f) for f, _ in pages)
    length = np.array([len(f) for f, _ in pages])
    mask = np.arange(t)[None, :] < length[:, None]
    gold = np.zeros((n, t), dtype=np.int64)
    for k, (_, labels) in enumerate(pages):
        gold[k, : len(labels)] = labels
    spots = np.flatnonzero(mask.ravel())
    sizes = np.array([len(f) for fs, _ in pages for f in fs])
    flat = np.array([f for fs, _ in pages for one in fs for f in one])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    told = np.eye(2)[gold]
    moved = np.einsum("nti,ntj->ij", told[:, :-1] * mask[:, 1:, None], told[:, 1:] * mask[:, 1:, None])
    steps = [(state, Momentum(state)), (move, Momentum(move))]
    for n_round in range(rounds):
        scores = np.zeros((n * t, 2))
        scores[spots] = np.add.reduceat(state[flat], starts, axis=0)
        scores = scores.reshape(n, t, 2)
        forward = np.zeros((n, t, 2))
        forward[:, 0] = scores[:, 0]
        for k in range(1, t):
            forward[:, k] = np.where(mask[:, k, None], scores[:, k] + _sum(forward[:, k - 1, :, None] + move[None], 1), forward[:, k - 1])
        whole = _sum(forward[:, -1], 1)
        behind = np.zeros((n, t, 2))
        pairs = np.zeros((2, 2))
        for k in range(t - 2, -1, -1):
            ahead = scores[:, k + 1] + behind[:, k + 1]
            behind[:, k] = np.where(mask[:, k + 1, None], _sum(move[None] + ahead[:, None, :], 2), 0.0)
            p = np.exp(forward[:, k, :, None] + move[None] + ahead[:, None, :] - whole[:, None, None])
            pairs += (p * mask[:, k + 1, None, None]).sum(axis=0)
        expected = np.exp(forward + behind - whole[:, None, None])
        error = (told - expected).reshape(n * t, 2)[spots]
        slope = -decay * n * state
        np.add.at(slope, flat, error[owner])
        for (weights, momentum), up in zip(steps, (slope, moved - pairs - STIFF * decay * n * move), strict=True):
            weights += rate * min(1.0, (n_round + 1) / WARM) * (1 - n_round / rounds) * momentum.step(up)
    return Crf(state, move)


def labelled(seed: int, layouts=LAYOUTS) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and labels of a made page; the blocks found are matched with the made ones in order."""
    html, told = page(seed, layouts)
    found = blocks(html)
    labels, at = [], 0
    for b in found:
        while at < len(told) and told[at][0] != b.text:
            at += 1
        if at == len(told):
            raise ValueError(f"page {seed}: the blocks are not those that were made")
        labels.append(int(told[at][1]))
        at += 1
    return [features(b, k, len(found)) for k, b in enumerate(found)], labels


def fitted(pages: int = PAGES, layouts=LAYOUTS) -> Crf:
    """The recipe: pages of all layouts in turn."""
    return train([labelled(seed, layouts) for seed in range(pages)])


@lru_cache(maxsize=1)
def trained() -> Crf:
    """The fitted weights that lie beside this file."""
    with np.load(WEIGHTS) as told:
        return Crf(told["state"].astype(np.float64), told["move"].astype(np.float64))


def main_text(html: str, crf: Crf) -> str:
    found = blocks(html)
    labels = crf.decode([features(b, k, len(found)) for k, b in enumerate(found)])
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y == ARTICLE)


def _extract(batches: Iterator[pa.RecordBatch], crf) -> Iterator[pa.RecordBatch]:
    model = Crf(*crf.value)
    for batch in batches:
        texts = [main_text(html.as_py() or "", model) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", crf: Crf | None = None) -> DataFrame:
    """(page_id, url, text): the article of each page, its blocks joined by a line feed."""
    crf = crf or trained()
    sent = pages.sparkSession.sparkContext.broadcast((crf.state.astype(np.float32), crf.move))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract, crf=sent), "page_id long, url string, text string")


if __name__ == "__main__":
    made = fitted()
    np.savez_compressed(WEIGHTS, state=made.state.astype(np.float32), move=made.move)
