"""SentencePiece encoding and decoding with N-best segmentation.

The pieces that fit a text form a lattice; a segmentation is a path and its
score the sum of its pieces' scores. A forward Viterbi pass gives the best
score up to every place. These scores are exact heuristics for an A* search
from the end of the lattice backwards: paths leave the queue in order of their
full score, so the first N complete ones are the N best.

No piece reaches over certain neighbouring characters (a letter followed by a
space mark, or any two characters that no piece holds side by side), so the
lattice of a text falls into segments whose paths combine freely. Each worker
keeps, in a dictionary bounded in bytes, the best path of segments it has met
and the loss of their second path; the search runs in the segments whose
second path is among the N - 1 least losses of the text, since no other
segment can take part in the N best.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_of

N_BEST = 4
SPACE = "▁"
CACHE_BYTES = 256 << 20
ENTRY_BYTES = 300
WHOLES = 20_000
# A character without a piece costs this much more than the dearest piece.
UNKNOWN_PENALTY = 10.0
STEP_TEXTS = 64
SEGMENT = re.compile(SPACE + "+[^" + SPACE + "]*|[^" + SPACE + "]+")


class PieceModel:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        self.arcs: dict[str, tuple[int, float] | None] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.pairs: set[str] = set()
        self.unknown = sp.unk_id()
        least = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                score = sp.get_score(i)
                if score > -1e8:  # user-defined space runs carry a sentinel score
                    least = min(least, score)
                self.arcs[piece] = (i, score)
                for end in range(1, len(piece)):
                    self.arcs.setdefault(piece[:end], None)
                self.pairs.update(piece[k:k + 2] for k in range(len(piece) - 1))
        self.unknown_score = least - UNKNOWN_PENALTY
        # The pieces as a tree of characters: a node is its children and its arc.
        self.root: tuple[dict, tuple[int, float] | None] = ({}, self.arcs.get(""))
        for text in sorted(self.arcs):  # prefixes come first
            node = self.root
            for ch in text[:-1]:
                node = node[0][ch]
            if text:
                node[0][text[-1]] = ({}, self.arcs[text])
        self.wholes: dict[tuple[str, int], list] = {}
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.held = 0

    # -- the lattice of one segment

    def lattice(self, s: str) -> list[list[tuple[int, float, int]]]:
        """Per end place: (start, score, id) of the pieces that end there; id -1
        stands for a character in bytes."""
        n, arcs = len(s), self.arcs
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                sub = s[i:j]
                if sub not in arcs:
                    break
                arc = arcs[sub]
                if arc is not None:
                    ends[j].append((i, arc[1], arc[0]))
                    single = single or j == i + 1
            if not single:
                ends[i + 1].append((i, self.unknown_score, -1))
        return ends

    @staticmethod
    def forward(ends: list) -> tuple[list[float], list]:
        """Viterbi: the best score up to every place and the last arc of its path."""
        best, back = [0.0], [None]
        for arcs in ends[1:]:
            top = max(arcs, key=lambda a: best[a[0]] + a[1])  # ties: the first, longest piece
            best.append(best[top[0]] + top[1])
            back.append(top)
        return best, back

    def ids(self, s: str, path: list[tuple[int, float, int]], ends: list[int]) -> array:
        out = array("I")
        for (start, _, piece), end in zip(path, ends):
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids.get(b, self.unknown) for b in s[start:end].encode())
        return out

    def _first(self, s: str) -> tuple[bytes, float, float]:
        """Ids of the best path, its score, and the loss of the second path, by
        one forward pass that keeps the two best scores of every place."""
        n, root = len(s), self.root[0]
        worst = float("-inf")
        best, second, back = [0.0] + [worst] * n, [worst] * (n + 1), [None] * (n + 1)
        for i in range(n):
            here, below, single = best[i], second[i], False
            children, j = root, i
            for ch in s[i:] if i else s:
                node = children.get(ch)
                if node is None:
                    break
                children, arc = node
                j += 1
                if arc is None:
                    continue
                single = single or j == i + 1
                score = here + arc[1]
                if score > best[j]:
                    second[j] = max(best[j], second[j], below + arc[1])
                    best[j], back[j] = score, (i, arc[1], arc[0])
                elif score > second[j]:
                    second[j] = score
            if not single:
                score = here + self.unknown_score
                if score > best[i + 1]:
                    second[i + 1] = max(best[i + 1], second[i + 1], below + self.unknown_score)
                    best[i + 1], back[i + 1] = score, (i, self.unknown_score, -1)
                elif score > second[i + 1]:
                    second[i + 1] = score
        path, stops, at = [], [], n
        while at:
            path.append(back[at])
            stops.append(at)
            at = back[at][0]
        return self.ids(s, path[::-1], stops[::-1]).tobytes(), best[n], best[n] - second[n]

    def search(self, s: str, count: int) -> list[tuple[float, bytes]]:
        """The ``count`` best paths of a segment: (score, ids), best first."""
        lattice = self.lattice(s)
        best, _ = self.forward(lattice)
        queue, order, found = [(-best[-1], 0, len(s), 0.0, None)], 0, []
        while queue and len(found) < count:
            _, _, at, score, path = heapq.heappop(queue)
            if at == 0:
                arcs, stops = [], []
                while path is not None:
                    arc, end, path = path
                    arcs.append(arc)
                    stops.append(end)
                found.append((score, self.ids(s, arcs, stops).tobytes()))
                continue
            for arc in lattice[at]:
                order += 1
                total = score + arc[1]
                heapq.heappush(queue, (-(total + best[arc[0]]), order, arc[0], total, (arc, at, path)))
        return found

    # -- whole texts

    def segments(self, text: str) -> list[str]:
        """Segments of a text whose lattices do not touch."""
        return SEGMENT.findall(self.normalize(text)) if text else []

    def _cuts(self, s: str) -> list[str]:
        """A segment cut between characters that no piece holds side by side
        (looked for only where it is more than one word of letters)."""
        if s.lstrip(SPACE).isalpha():
            return [s]
        out, start, pairs = [], 0, self.pairs
        for k in range(1, len(s)):
            if s[k - 1:k + 1] not in pairs:
                out.append(s[start:k])
                start = k
        out.append(s[start:])
        return out

    def first(self, s: str) -> tuple[bytes, float, float]:
        entry = self.known.get(s)
        if entry is None:
            parts = self._cuts(s)
            if len(parts) == 1:
                entry = self._first(s)
            else:
                entries = [self.first(p) for p in parts]
                entry = (b"".join(e[0] for e in entries), sum(e[1] for e in entries), min(e[2] for e in entries))
            self.known[s] = entry
            self.held += ENTRY_BYTES + len(s) + len(entry[0])
        return entry

    def nbest(self, text: str, count: int = N_BEST) -> list[tuple[float, bytes]]:
        """The ``count`` best segmentations of a whole text: (score, ids as four
        bytes each), best first; an empty text has one, without ids."""
        if self.held > CACHE_BYTES:  # the half that was met first holds the frequent segments
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.held = sum(ENTRY_BYTES + len(k) + len(e[0]) for k, e in self.known.items())
        segments = self.segments(text)
        if not segments:
            return [(0.0, b"")]
        known, first = self.known, self.first
        parts, scores, losses = zip(*[known.get(s) or first(s) for s in segments])
        base, best = sum(scores), b"".join(parts)
        if count == 1:
            return [(base, best)]
        # The segments with the least losses, ties to the earlier one.
        lost = np.array(losses)
        if len(lost) >= count:
            places = np.flatnonzero(lost <= np.partition(lost, count - 2)[count - 2])
        else:
            places = np.arange(len(lost))
        places = [int(k) for k in places[np.lexsort((places, lost[places]))][:count - 1] if lost[k] < np.inf]
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for k in places:
            options = self.wholes.get((segments[k], count)) or self._whole(segments[k], count)
            combos = heapq.nsmallest(count, (
                (loss + scores[k] - score, (*swaps, (k, ids)) if rank else swaps)
                for loss, swaps in combos for rank, (score, ids) in enumerate(options)))
        starts = [0, *accumulate(map(len, parts))]
        out = []
        for loss, swaps in combos:
            ids = best
            for k, changed in sorted(swaps, reverse=True):
                ids = ids[:starts[k]] + changed + ids[starts[k + 1]:]
            out.append((base - loss, ids))
        return out

    def _whole(self, s: str, count: int) -> list[tuple[float, bytes]]:
        """N best of a segment, its parts combined; kept, since the segments of
        least loss are mostly the same frequent ones."""
        combos = [(0.0, b"")]
        for part in self._cuts(s):
            combos = heapq.nlargest(count, (
                (score + more, ids + added) for score, ids in combos for more, added in self.search(part, count)),
                key=lambda c: c[0])
        if len(self.wholes) >= WHOLES:
            self.wholes = {}
        self.wholes[s, count] = combos
        return combos

    def decode(self, ids: bytes) -> str:
        """The text of some ids: space marks are spaces, the first one is dropped."""
        raw = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per worker process and model file."""
    return PieceModel(path)


def encode_nbest(docs: DataFrame, model: str, count: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, scores (best first), n_pieces of the best,
    crc32 of each segmentation's ids, and ``round_trip``: whether the best ids
    decode to the text; with ``with_ids`` also ids, an array per segmentation.

    ``model`` is the path of a model file. A null text is empty; an empty text
    has one segmentation, without ids, of score 0. A text with fewer
    segmentations than ``count`` returns all it has. Rows that repeat a doc_id
    are documents of their own. An empty table gives an empty result; further
    columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(at, STEP_TEXTS)
                texts = part.column(1).to_pylist()
                found = [pieces.nbest(t, count) for t in texts]
                arrays = [part.column(0), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                          pa.array([len(f[0][1]) // 4 for f in found], pa.int64()),
                          pa.array([[zlib.crc32(i) for _, i in f] for f in found], pa.list_(pa.int64())),
                          pa.array([pieces.decode(f[0][1]) == t for f, t in zip(found, texts)])]
                if with_ids:
                    arrays.append(pa.array([[memoryview(i).cast("I").tolist() for _, i in f] for f in found],
                                           pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(
                    arrays, ["doc_id", "scores", "n_pieces", "crc32", "round_trip"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, scores array<double>, n_pieces long, crc32 array<long>, round_trip boolean"
             + (", ids array<array<int>>" if with_ids else ""))


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>); null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [pieces.decode(array("I", ids or []).tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")
