"""Token counts of whole texts by a byte-level BPE vocabulary.

A text is cut at the vocabulary's special strings (one token each) and then
into chunks as the tokenizer's pre-tokenizer cuts it. In a chunk the bytes are
the first symbols, linked to their neighbours; a heap holds the adjacent pairs
that have a merge, and the one of the lowest rank (the leftmost among equal
ones) is popped and merged until none is left. The count is the number of
bytes less the number of merges; no identifier is built.

Rows are counted where they are read: nothing is shuffled. A Python worker
keeps the counts of chunks it has met in a dictionary bounded in bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_of

CACHE_BYTES = 160 << 20
ENTRY_BYTES = 160  # of a dictionary entry besides its characters
LIMIT = 512
STEP_TEXTS = 256
# The public pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_count(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> int:
    """Merges that byte-pair encoding makes in a run of symbols.

    ``ranks`` maps a pair (left << 32 | right) to its rank and its product."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for at in range(n - 1):
        found = ranks.get(symbols[at] << 32 | symbols[at + 1])
        if found:
            heap.append((found[0], at))
    heapify(heap)
    merges = 0
    while heap:
        rank, at = heappop(heap)
        after = right[at]
        if symbols[at] < 0 or after >= n:
            continue
        found = ranks.get(symbols[at] << 32 | symbols[after])
        if not found or found[0] != rank:  # one of the two has merged otherwise meanwhile
            continue
        symbols[at], symbols[after] = found[1], -1
        merges += 1
        after = right[at] = right[after]
        if after < n:
            left[after] = at
            found = ranks.get(symbols[at] << 32 | symbols[after])
            if found:
                heappush(heap, (found[0], at))
        before = left[at]
        if before >= 0:
            found = ranks.get(symbols[before] << 32 | symbols[at])
            if found:
                heappush(heap, (found[0], before))
    return merges


class TokenCounter:
    """Counts the tokens of texts as the tokenizer file at ``path`` makes them.

    The file has to hold byte-level BPE with the public pattern and no
    normalizer; others are refused. A character is left to ``PATTERN`` only
    after the installed library has been seen to cut around it alike (its
    Unicode tables may be older); a text with another character is cut by the
    library's own pre-tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (spec["normalizer"] or model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"]
                or not cut.get("use_regex", True) or any(model.get(k) for k in (
                    "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
            raise ValueError("not a plain byte-level BPE file")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special strings that take their surroundings are not supported")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.chunks = regex.compile(PATTERN).findall
        vocab = model["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.first = [vocab[chr(b) if b in shown else chr(next(hidden))] for b in range(256)]
        self.alike: set[str] = set(map(chr, range(128)))
        self.apart: set[str] = set()
        self.known: dict[str, int] = {}
        self.held = 0

    def _library_chunks(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def _cut(self, text: str) -> list[str]:
        if not text.isascii():
            letters = set(text)
            for c in letters - self.alike - self.apart:
                probe = f"a{c}a1{c}1 {c}a"
                (self.alike if self._library_chunks(probe) == self.chunks(probe) else self.apart).add(c)
            if letters & self.apart:
                return self._library_chunks(text)
        return self.chunks(text)

    def _count_chunk(self, chunk: str) -> int:
        symbols = [self.first[b] for b in chunk.encode()]
        count = len(symbols) - merge_count(symbols, self.ranks)
        if len(chunk) < CACHE_BYTES >> 8:
            self.known[chunk] = count
            self.held += len(chunk) + ENTRY_BYTES
            if self.held > CACHE_BYTES:  # the half that was met first holds the frequent chunks
                self.known = dict(islice(self.known.items(), len(self.known) // 2))
                self.held = sum(map(len, self.known)) + ENTRY_BYTES * len(self.known)
        return count

    def _count_plain(self, text: str) -> int:
        chunks = self._cut(text)
        counts = list(map(self.known.get, chunks))
        if None in counts:
            counts = [self._count_chunk(c) if n is None else n
                      for c, n in zip(chunks, map(self.known.get, chunks))]
        return sum(counts)

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self._count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._count_plain, parts))


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """One per worker process and tokenizer."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens; a null doc_id stays null.
    Rows that repeat a doc_id or a text are counted each. A pair met twice in a
    chunk with equal ranks merges from the left, as in the library. A very long
    run without a cut costs its length times the logarithm of it. Further
    columns are ignored, an empty table gives an empty result. ``tokenizer`` is
    a path that every worker can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(at, STEP_TEXTS)
                tokens = [counter(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tokens, pa.int64()),
                     pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text_of()).cast("long").alias("n_bytes"),
                       text_of().alias("text")).mapInArrow(run, COUNTS)
