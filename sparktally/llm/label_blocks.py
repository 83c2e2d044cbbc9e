"""Draws the labelled table of html_text from pages: ``python -m sparktally.llm.label_blocks pages.parquet``.

A page that marks its article up labels its own blocks: content is what stands in the article and in no furniture. Every
page is shown with blocks cut away or moved, three in five with their markup hidden, so that a tree learns from word
counts and link shares what it would else read from the markup. Pages whose id is even are drawn, the others are held out.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd

from .html_text import Block, blocks, features

#: How many of the pages are drawn without their markup.
HIDDEN_SHARE = 0.6


def shown(page: list[Block], rng: np.random.Generator) -> list[tuple[float, ...]]:
    """The page's rows of features with their labels, in one random state of its order, furniture and markup.

    Any block may be cut away, and furniture may stand anywhere, even within the article, so that neither its place nor
    its neighbours alone tell what a block is; sometimes words are cut from its end. The markup is hidden or shown.
    """
    hidden = rng.random() < HIDDEN_SHARE
    kept = [b for b in page if rng.random() < 0.75]
    if rng.random() < 0.5:
        loose = [b for b in kept if b.kind < 1]
        kept = [b for b in kept if b.kind >= 1]
        for b in loose:
            kept.insert(int(rng.integers(len(kept) + 1)), b)
    cut = [b.words if rng.random() < 0.7 else max(1, int(b.words * rng.random())) for b in kept]
    seen = [Block(b.text, n, b.density, 1 if hidden else b.kind) for b, n in zip(kept, cut, strict=True)]
    return [(*row, float(b.kind == 2)) for row, b in zip(features(seen), kept, strict=True)]


def table(pages: pd.DataFrame, rows: int, seed: int = 3) -> list[tuple[float, ...]]:
    rng, found = np.random.default_rng(seed), {}
    drawn = pages[pages["page_id"] % 2 == 0].sort_values("page_id")
    for html in drawn["html"].sample(frac=1, random_state=seed):
        page = blocks(html or "")
        if any(b.kind == 2 for b in page):
            mine = shown(page, rng)
            for i in rng.choice(len(mine), min(4, len(mine)), replace=False):
                found.setdefault(mine[i])
        if len(found) >= rows:
            break
    return list(found)[:rows]


if __name__ == "__main__":
    out = ["|".join(f"{v:g}" if i % 2 == 0 or i > 9 else f"{v:.2g}" for i, v in enumerate(r)).replace("|", " ") for r in table(pd.read_parquet(sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 640)]
    print("\n".join("|".join(out[i : i + 8]) for i in range(0, len(out), 8)))
