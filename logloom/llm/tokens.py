"""Token ids of whole texts by an installed public tokenizer.

The tokenizer's pre-tokenizer never joins characters across a space or a line
feed, and its normalizer treats both alike, so a text's ids are the ids of its
space-separated chunks in a row; a tokenizer that does otherwise is refused. Each Python worker keeps the ids of chunks it
has met in a dictionary bounded in bytes; only new chunks are tokenized. A
chunk of Latin letters with punctuation behind them, which the pre-tokenizer
cuts in two, goes to the tokenizer's model directly if that gives the whole
tokenizer's ids for every such letter and mark; any other chunk takes the whole
tokenizer. Such a tokenizer's texts are lower-cased (A-Z) and cut between a
letter and the usual marks first, unless some text holds one of its added tokens.
"""

from __future__ import annotations

import os
import string
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 200 << 20
ENTRY_BYTES = 200  # of a dictionary entry besides its key and ids
STEP = 4096
MARKS = ".,;:!?"  # cut off the letter before them when texts are looked up
# Letters below this are in Unicode's composed form already.
COMPOSED = "\u0250"


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ChunkIds:
    """Two-byte little-endian ids of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("token ids need two bytes at most")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = self._probe()

    def _probe(self) -> bool:
        """Whether the model alone spells letters and words before marks as the whole tokenizer does."""
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if any(whole(f"ab,{gap}cd{gap}{gap}é") != whole("ab,") + whole("cd") + whole("é") for gap in " \n"):
            raise ValueError("this tokenizer does not cut texts at spaces")
        letters = [c for c in map(chr, range(ord(COMPOSED))) if c.isalpha() and c.lower().isalpha() and len(c.lower()) == 1]
        alone = lambda word: [t.id for t in self.model.tokenize(
            "".join(self.letters[b] for b in word.lower().encode()))]
        return (all(whole(word) == alone(word) for c in letters for word in (c, f"T{c}on")) and
                all(whole(f"One{mark}") == alone("One") + whole(mark) for mark in string.punctuation) and
                all(whole(f"{a}{mark}{b}") == whole(a) + whole(mark + b)
                    for mark in MARKS for a in ("Ab", "7b", "éb") for b in ("", "cD", "7", "É", mark, "'s", "\u0301")))

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.known[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES

    def _whole(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), STEP):
            part = chunks[at:at + STEP]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self._keep(chunk, array("H", found.ids).tobytes())

    def _of_letters(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            spelt = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            ids = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            self._keep(word, ids)
        return ids

    def _learn(self, chunks: list[str]) -> None:
        others, tails = [], []
        for chunk in chunks:
            core = chunk.rstrip(string.punctuation)
            word = core.lower()
            if self.direct and core.isalpha() and (
                    core.isascii() or word.isalpha() and len(word) == len(core) and max(core) < COMPOSED):
                ids = self._of_letters(word)
                if len(core) < len(chunk):
                    tail = self.known.get(chunk[len(core):])
                    if tail is None:
                        tails.append((chunk, ids, chunk[len(core):]))
                        continue
                    ids += tail
                if chunk not in self.known:
                    self._keep(chunk, ids)
            else:
                others.append(chunk)
        self._whole(list({*others, *(t for _, _, t in tails)}.difference(self.known)))
        for chunk, ids, tail in tails:
            self._keep(chunk, ids + self.known[tail])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. A step's
        distinct chunks are looked up once, the rest is arithmetic on arrays."""
        if self.direct and not any(pc.any(pc.match_substring(texts, t, ignore_case=True)).as_py() for t in self.added):
            texts = pc.ascii_lower(texts)
            texts = pc.replace_substring_regex(texts, f"([a-z])([{MARKS}])", r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        # One string, cut at its spaces, is far quicker than one string each.
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        distinct = pc.binary_join(one, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        if self.held > CACHE_BYTES:  # the half that was met first holds the frequent chunks
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.held = sum(map(len, self.known)) + sum(map(len, self.known.values())) + ENTRY_BYTES * len(self.known)
        found = list(map(self.known.get, distinct))
        new = [at for at, x in enumerate(found) if x is None]
        if new:
            self._learn([distinct[at] for at in new])
            for at in new:
                found[at] = self.known[distinct[at]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[chunk]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        # Where a chunk's ids stand among those of the distinct chunks, less where they go.
        shift = (np.cumsum(size) - size)[chunk] - upto[:-1]
        ids = np.frombuffer(b"".join(found), "<u2")[np.repeat(shift, sizes) + np.arange(upto[-1])]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids, np.diff(upto[ends])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[b - n:b].tobytes() for n, b in zip(counts.tolist(), ends.tolist())]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One per worker process and tokenizer."""
    return ChunkIds(path)
