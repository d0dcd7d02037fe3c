"""Main text of web pages: every block is labelled by a recurrent network that reads the whole page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.llm.block_lstm import scores, train
from loglode.llm.common import chunks, map_arrow
from loglode.llm.html_blocks import Block, blocks

#: Pages the labeller is fitted on, drawn by a hash of their text; only pages of up to TRAIN_BYTES are drawn.
TRAIN_PAGES = 160
TRAIN_BYTES = 20_000

# Words of element names, classes and ids that say what a part of a page is.
MAIN = "article main".split()
FURNITURE = (
    "nav header footer aside form head button select dialog menu banner sidebar widget advert ad ads sponsored promo cookie consent notice newsletter "
    "subscribe share social related comment comments respond breadcrumb pagination"
).split()
CONTENT = "content post entry story body text single blog page".split()


#: Elements that are furniture with all they hold, an article in them too.
OUTER = "nav header footer aside form dialog".split()
#: Text that reads like main text where no markup tells: long, and little of it linked.
LONG_TEXT, LINKED_SHARE = 80, 0.2


def rule_label(block: Block) -> int:
    """Whether the markup itself says that a block is main text: in an article, and in no furniture inside it or around it.

    Names around the article (a wrapper `with-sidebar`) say nothing about it, only elements that are furniture do.
    """
    inner = max((i for i, w in enumerate(block.path) if w in MAIN), default=-1)
    return int(inner >= 0 and not any(w in FURNITURE for w in block.path[inner:]) and not any(w in OUTER for w in block.path[:inner]))


def density_label(block: Block) -> int:
    """Of a page without an article: whether a block reads like main text, and nothing around it is named furniture."""
    return int(len(block.text) >= LONG_TEXT and block.linked < LINKED_SHARE * len(block.text) and not any(w in FURNITURE for w in block.path))


def labels_of(page: list[Block]) -> list[int]:
    """Labels by markup, where the page has an article; otherwise by how its blocks read."""
    marks = [rule_label(b) for b in page]
    return marks if any(w in MAIN for b in page for w in b.path) else [density_label(b) for b in page]


def practice_pages(pages: list[list[Block]], seed: int = 11) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Training pages with labels: the given ones, and each more often with its parts in other markup and other parts between.

    In one copy the main text is in an article in other places, in another one in plain or named div and section elements,
    or in none: there the texts around a block, its own words and length, and the names of the other parts decide.
    """
    rng = np.random.default_rng(seed)
    made, labels = [], []
    scraps = [b for page in pages for b, mark in zip(page, labels_of(page), strict=True) if not mark] or [Block(("html", "body", "nav"), "Home", 4)]
    for page in pages:
        marks = labels_of(page)
        made.append(page)
        labels.append(np.array(marks))
        word = str(rng.choice(CONTENT))
        marked = [("article",), ("main",), ("main", "article"), ("div", word, "article"), ("section", "article", word), ("div", "with", "sidebar", "article")]
        unmarked = [("div", word), ("section", word), ("div",), ("section",), (), ("div", "div", word), ("table", "tbody", "tr", "td")]
        for holders in (marked, unmarked):
            shell = ("html", "body", *[(), ("div",), ("div", "page"), ("div", "wrapper")][rng.integers(4)])
            holder = holders[rng.integers(len(holders))]
            other: list[tuple[Block, int]] = []
            for b, mark in zip(page, marks, strict=True):
                other.append((b._replace(path=(*shell, *holder, b.path[-1] if b.path else "p")), 1) if mark else (b, 0))
            for _ in range(rng.integers(2, 7)):
                kind = str(rng.choice(FURNITURE))
                tag = kind if kind in OUTER else str(rng.choice(["div", "section", "ul", "aside"]))
                path = (*shell, *(holder if rng.random() < 0.5 else ()), *dict.fromkeys([tag, kind]), str(rng.choice(["p", "li", "div", "h2", "span"])))
                at = int(rng.integers(0, len(other) + 1))
                for _ in range(rng.integers(1, 4)):
                    pool = scraps if rng.random() < 0.5 else page
                    text = pool[rng.integers(len(pool))].text if pool else "Home"
                    other.insert(at, (Block(path, text, len(text) if rng.random() < 0.3 else 0), 0))
            made.append([b for b, _ in other])
            labels.append(np.array([y for _, y in other]))
    return made, labels


def sample(pages: DataFrame, count: int, most_bytes: int) -> list[str]:
    """`count` pages of up to most_bytes, those with the smallest hashes, copies once.

    The pages are first counted by their hashes, so that only the lower end of the hash range goes on: some pages more
    than asked for, however many there are.
    """
    rows = pages.select(F.col("`html`").alias("html")).where(F.length("html").between(1, most_bytes))
    rows = rows.withColumn("h", F.xxhash64("html"))
    different = rows.agg(F.approx_count_distinct("h").alias("n")).first().n
    end = -(2.0**63) + min(1.0, 4.0 * count / max(different, 1)) * 2.0**64
    return [r.html for r in rows.where(F.col("h") <= F.lit(end)).dropDuplicates(["h"]).orderBy("h").limit(count).collect()]


def fit(pages: DataFrame, count: int = TRAIN_PAGES, most_bytes: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Weights of the labeller from a bounded sample of the pages, labelled by their own markup or, without any, by density."""
    found = sample(pages, count, most_bytes)
    return train(*practice_pages([p for page in found if (p := blocks(page))] or [[Block(("html", "body", "article", "p"), "Text.", 0)]]))


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html", 2 << 20):
            pages = [blocks(h) for h in part.column("html").to_pylist()]
            texts = ["\n".join(b.text for b, s in zip(p, found, strict=True) if s > 0) for p, found in zip(pages, scores(shared.value, pages), strict=True)]
            arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return run


def main_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row of pages (page_id, url, html, ...).

    A page is cut into its blocks (`html_blocks.blocks`). Each block is a vector of its tag path and of its hashed words;
    a bidirectional LSTM reads the sequence both ways, so a block is judged with the whole page in view. Blocks judged
    main text are joined by line feeds in page order. The weights, some 60 kB, are broadcast; pages do not move.
    Without weights the labeller is first fitted to TRAIN_PAGES pages (`fit`), always to the same ones.

    Defined cases: a null or empty html, or one without main text, gives an empty text; null page_id and url are carried;
    repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if weights is None else weights)
    slim = pages.select(*[F.col(f"`{c}`") for c in ("page_id", "url", "html")])
    return map_arrow(slim, _extract(shared), "page_id long, url string, text string, n_chars long, n_blocks long")
