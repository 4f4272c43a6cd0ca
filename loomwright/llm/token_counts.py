"""Token counts by offset-mapped attribution: whole documents are encoded once, sections get tokens by their spans.

A token's span is the smallest run of code points that holds all its bytes. Sections are half-open code point intervals
that cover the text. Both lists are sorted, so their interval join is two binary searches per document. A token that
lies in one section counts there; one that crosses a boundary goes whole to the section that holds most of its code
points, of equal ones the first. So a document's section counts add up to its token count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm.bpe import PairIndexBpe, default_path, parts, tokenizer


def line_sections(text: str) -> list[int]:
    """Where the lines of text start; a line feed belongs to the line it ends. An empty text has one empty section."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def token_spans(bpe: PairIndexBpe, text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point and end (exclusive) of every token, from the word numbers of text."""
    ids = np.concatenate([bpe.ids[w] for w in words.tolist()]) if len(words) else np.zeros(0, np.int32)
    stop = np.cumsum(token_sizes(bpe)[ids])
    start = stop - token_sizes(bpe)[ids]
    if text.isascii():
        return start, stop
    raw = np.frombuffer(text.encode(), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    return point[start], point[stop - 1] + 1


def token_sizes(bpe: PairIndexBpe) -> np.ndarray:
    if not hasattr(bpe, "sizes"):
        bpe.sizes = np.array([len(x) for x in bpe.token_bytes], np.int64)
    return bpe.sizes


def attribute(starts: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross one of its boundaries. starts: where each section begins."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, stop - 1, "right") - 1
    crossing = np.flatnonzero(a != b)
    for k in crossing.tolist():
        own = range(a[k], b[k] + 1)
        held = [min(stop[k], starts[s + 1] if s + 1 < len(starts) else stop[k]) - max(first[k], starts[s]) for s in own]
        a[k] = own[held.index(max(held))]
    n = len(starts)
    return np.bincount(a, minlength=n), np.bincount(a[crossing], minlength=n)


def section_token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sections=line_sections) -> DataFrame:
    """One row per document and section: id_col, section (from 0), start, stop (code points), n_tokens, n_crossing, doc_tokens.

    sections: gives the ascending starts of a text's sections, the first of which is 0; lines by default. Null counts
    as an empty text, which has one section of no tokens. Repeated rows are counted each on their own, an empty table
    gives no rows, and other columns are ignored.
    """

    def run(batches):
        bpe = tokenizer(path or default_path())
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                bpe.fresh_batch()
                numbers = [bpe.number(x) for x in texts]
                bpe.settle()
                for start in range(0, len(texts), 256):
                    rows = []
                    for k in range(start, min(start + 256, len(texts))):
                        cuts = np.array(sections(texts[k]), np.int64)
                        first, stop = token_spans(bpe, texts[k], numbers[k])
                        own, crossing = attribute(cuts, first, stop)
                        rows.append((np.full(len(cuts), at + k), np.arange(len(cuts)), cuts, np.append(cuts[1:], len(texts[k])), own, crossing, np.full(len(cuts), len(first))))
                    of, *columns = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.record_batch([batch.column(0).take(pa.array(of)), *(pa.array(x.astype(np.int64)) for x in columns)], names=[id_col, *NAMES])
        bpe.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) as `text`").mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{x} bigint" for x in NAMES))


NAMES = ["section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"]
