"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements whose leaves are text blocks. Boosted
trees give every node the log-odds that it holds main text, from its tag, the
words of its attributes and of those above it, subtree density, depth and
sibling statistics. Decoding picks the set of nodes with the highest total in
which every chosen node's parent is chosen too, so no block is kept below an
ancestor that is rejected. Kept blocks, in page order, are the text.

The model is fitted on the driver to ``TRAINING_PAGES`` generated pages with
known labels (``html_pages``) and sent to the executors (some 50 kB).

Defined results: a null or empty page, or one without main text, gives the empty
string and 0; broken markup is parsed as far as it goes and never raises; white
space inside a block, ``<br>`` included, is one space; repeated rows each get
their text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from findery.llm import dom
from findery.llm.boosting import Boosted, fit
from findery.llm.html_pages import labelled_pages

#: Labelled pages that the model is fitted to, whatever the input.
TRAINING_PAGES = 900
SEED = 5


def labels(nodes: list[dom.Node]) -> np.ndarray:
    """1 for blocks whose nearest marked ancestor says main text, and for elements that hold such a block."""
    y = np.zeros(len(nodes))
    place = {id(v): i for i, v in enumerate(nodes)}
    for i, v in enumerate(nodes):
        if v.tag == "#block":
            up = v.parent
            while up is not None and up.mark is None:
                up = up.parent
            y[i] = up is not None and up.mark == "1"
    for i in range(len(nodes) - 1, -1, -1):
        p = place.get(id(nodes[i].parent), -1)
        if p >= 0 and y[i]:
            y[p] = 1
    return y


@functools.cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """The model fitted to ``pages`` generated pages; once in a process."""
    rows, targets = [], []
    for page in labelled_pages(pages, seed):
        nodes = dom.flat(dom.parse(page))
        rows.append(dom.features(nodes))
        targets.append(labels(nodes))
    return fit(np.concatenate(rows), np.concatenate(targets))


def decode(nodes: list[dom.Node], scores: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes with the highest sum of scores."""
    best = scores.copy()
    place = {id(v): i for i, v in enumerate(nodes)}
    parent = [place.get(id(v.parent), -1) for v in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        if best[i] > 0 and parent[i] >= 0:
            best[parent[i]] += best[i]
    chosen = np.zeros(len(nodes), dtype=bool)
    for i in range(len(nodes)):
        chosen[i] = best[i] > 0 and (parent[i] < 0 or chosen[parent[i]])
    return chosen


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    trees = [dom.flat(dom.parse(p)) if p else [] for p in pages]
    rows = [dom.features(t) for t in trees]
    scores = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, start = [], 0
    for nodes in trees:
        own = scores[start : start + len(nodes)]
        start += len(nodes)
        chosen = decode(nodes, own)
        out.append("\n\n".join(v.text for v, c in zip(nodes, chosen, strict=True) if c and v.tag == "#block"))
    return out


def extract_pages(pages: DataFrame, model: Boosted | None = None, batch_rows: int = 100) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; no shuffle."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, batch_rows):
                part = batch.slice(first, batch_rows)
                texts = extract(part.column(2).to_pylist(), model)
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes],
                    ["page_id", "url", "text", "n_chars"],
                )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {id_type}, url string, text string, n_chars long"
    )
