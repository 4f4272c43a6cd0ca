"""Byte-level BPE encoding and decoding by a pair occurrence index.

The words of a whole batch of texts are numbered, and those not seen before are merged together: one array holds their
symbols, an index maps each active pair's rank to all positions where the pair stands, and ranks are applied in
ascending order, each to all its positions at once; then only the pairs beside a merged position are looked up again
and filed under their ranks. Words are independent, and within a word this is the order of the library's own merges.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: No rank: the pair at this position can't be merged.
NONE = np.int32(2**31 - 1)
#: Words as the byte-level pre-tokenizer cuts them, for texts of code points below U+0250 only.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: What WORD and the library may see differently: other numbers among Latin-1, and all code points from U+0250.
ODD = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PairIndexBpe:
    """A tokenizer file of the byte-level BPE kind, with a bounded cache of the words seen."""

    def __init__(self, path: str, max_words: int = 100_000):
        """max_words: words kept before the cache starts anew; it bounds memory and changes no result."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, to_byte = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(map(to_byte.__getitem__, token))
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.decimal = [str(k) for k in range(size)]
        self.of_byte = np.zeros(256, np.int32)
        for token, b in to_byte.items():
            self.of_byte[b] = vocab[token]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = self.left.astype(np.int64) << 32 | self.right
        self.by_key = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.by_key]
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = _Numbered()
        self.ids: list[np.ndarray] = []
        self.done = 0
        self.text: list[str] = []
        self.raw: list[bytes] = []

    def words(self, text: str) -> list[str]:
        """The words of text, whose concatenation is text; a special token is a word of its own."""
        if self.split and (parts := self.split.split(text))[1:]:
            return [w for k, x in enumerate(parts) if x for w in ([x] if k % 2 else self._plain(x))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not ODD.search(text):
            return WORD.findall(text)
        return [text[a:b] for _, (a, b) in _library_words().pre_tokenize_str(text)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word ends in it."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(sym), np.cumsum(sizes)
        if not n:
            return sym, ends
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends[sizes > 0] - 1] = n
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[(ends - sizes)[sizes > 0]] = -1
        alive, rank = np.ones(n, bool), np.full(n, NONE, np.int32)
        at = np.flatnonzero(nxt < n)
        rank[at] = self.ranks(sym[at], sym[at + 1])
        mark, turn = np.zeros(n, np.int32), 0
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(where: np.ndarray) -> None:
            found = rank[where]
            if not (keep := found != NONE).all():
                where, found = where[keep], found[keep]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            where, found = where[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(where, cuts) if len(cuts) else [where], strict=True):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(heap, r)

        file(at)
        while heap:
            r = heapq.heappop(heap)
            lists = places.pop(r)
            pos = np.concatenate(lists) if len(lists) > 1 else lists[0]
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if self.left[r] == self.right[r]:
                pos = _apart(np.unique(pos), nxt)
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], nxt[pos], alive[gone], rank[gone] = self.made[r], after, False, NONE
            inner = after < n
            prv[after[inner]] = pos[inner]
            rank[pos] = NONE
            right = pos[inner]
            rank[right] = self.ranks(sym[right], sym[after[inner]])
            before = prv[pos]
            before = before[before >= 0]
            rank[before] = self.ranks(sym[before], sym[nxt[before]])
            turn += 1
            mark[right] = turn
            file(np.concatenate((right, before[mark[before] != turn])))
        return sym[alive], np.cumsum(alive)[ends - 1] if sizes.all() else np.concatenate(([0], np.cumsum(alive)))[ends]

    def number(self, text: str) -> np.ndarray:
        """The numbers of the words of text; settle() must follow before they're used."""
        words = self.words(text)
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def settle(self) -> None:
        """Merge the words numbered since the last time."""
        fresh = list(self.index)[self.done :]
        if not fresh:
            return
        plain = [b"" if w in self.special else w.encode() for w in fresh]
        flat, ends = self.merge(plain)
        listed, start = flat.tolist(), 0
        for w, end in zip(fresh, ends.tolist(), strict=True):
            ids = listed[start:end] if end > start else [self.special[w]]
            self.ids.append(flat[start:end] if end > start else np.array(ids, np.int32))
            start = end
            self.text.append(",".join(map(self.decimal.__getitem__, ids)))
            self.raw.append(self.decode_bytes(ids))
        self.done += len(fresh)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def fresh_batch(self) -> None:
        if len(self.index) > self.max_words:
            self.clear()

    def encode(self, text: str) -> list[int]:
        numbers = self.number(text)
        self.settle()
        return [int(k) for w in numbers for k in self.ids[w]]


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


def _apart(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions in ascending order, those that a left-to-right pass merges: every second one of each unbroken chain."""
    chained = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
    heads = np.flatnonzero(~chained)
    step = np.arange(len(pos)) - np.repeat(heads, np.diff(np.append(heads, len(pos))))
    return pos[step % 2 == 0]


@lru_cache(1)
def _library_words():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


@lru_cache(2)
def tokenizer(path: str) -> PairIndexBpe:
    """One for each Python worker, kept from task to task."""
    return PairIndexBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts(column: pa.Array, rows: int = 1000, most_bytes: int = 4 << 20):
    """(first row, texts) of runs of a batch's rows, which bound what is merged and held at once; a null is an empty text."""
    texts: list[str] = []
    start = size = 0
    for value in column:
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if len(texts) == rows or size > most_bytes:
            yield start, texts
            start, size, texts = start + len(texts), 0, []
    if texts:
        yield start, texts


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", form: str = "array", out_bytes: int = 4 << 20) -> DataFrame:
    """id_col, n_tokens, token_ids, decoded: the ids of every whole text, and what these ids decode to.

    path: a byte-level tokenizer file that every executor has; None: that of the public_tokenizers package there.
    form: "array" for token_ids as array<int>, "text" for the decimal ids joined by commas. A special token's string in
    a text is that token, as the library has it by default. Null and empty texts have no ids and decode to "". Bytes
    that are no UTF-8 decode to U+FFFD. Rows stay as many as they are; other columns are ignored.
    """

    def run(batches):
        bpe = tokenizer(path or default_path())
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                bpe.fresh_batch()
                numbers = [bpe.number(x) for x in texts]
                bpe.settle()
                keys, rows, size, start = batch.column(0), [], 0, at
                for k, words in enumerate(numbers, at + 1):
                    own = words.tolist()
                    decoded = b"".join(map(bpe.raw.__getitem__, own)).decode("utf-8", "replace")
                    ids = ",".join(map(bpe.text.__getitem__, own)) if form == "text" else np.concatenate([bpe.ids[w] for w in own]) if own else np.zeros(0, np.int32)
                    n = ids.count(",") + 1 if form == "text" and ids else len(ids)
                    rows.append((n, ids, decoded))
                    size += len(decoded) + 4 * n
                    if size > out_bytes or k == at + len(numbers):
                        n_tokens, token_ids, text = zip(*rows, strict=True)
                        kind = pa.string() if form == "text" else pa.list_(pa.int32())
                        yield pa.record_batch([keys.slice(start, len(rows)), pa.array(n_tokens, pa.int64()), pa.array(list(token_ids), kind), pa.array(text, pa.string())], names=[id_col, "n_tokens", "token_ids", "decoded"])
                        start, rows, size = k, [], 0
        # the worker stays for other tasks: it shouldn't hold these words
        bpe.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    ids = "string" if form == "text" else "array<int>"
    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) as `text`").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, token_ids {ids}, decoded string")
