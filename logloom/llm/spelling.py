"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

A word becomes the vector of its counts per letter group. One edit changes it
by at most one surplus and one deficit, so the words near a word lie in a trie
over the successive counts on the few paths that spend a budget of one each;
the words at the leaves are verified letter by letter. Of a pair, the word with
the smaller (vector, word) searches: it spends the surplus first.

The trie is never held whole. Its top levels are the shuffle key: a shard is
the sub-trie below one prefix of counts, and a word visits the shards whose
prefix its budget reaches. The number of levels in the key is the least whose
largest shard stays within a bound; a shard above it even then is dealt in
blocks, and whoever searches it visits each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_of, write_once

RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "".join(map(chr, range(65, 91)))
EDIT_MOD = 97
MIN_LETTERS = 5
MIN_TIMES = 3
FORM_FACTOR = 2
# Letter groups in trie order, the most telling first; other letters are a last group.
GROUPS = ("e", "n", "t", "a", "i", "r", "h", "s", "o", "d", "l", "u", "g", "c", "m", "bpf", "wvy", "kjqxz")
# Words of a shard, levels in its key at most, and words below which a node of the trie is a list.
SHARD_WORDS = 1 << 12
KEY_LEVELS = 12
LEAF_WORDS = 32
# Words with results that a task holds before it gives them out.
FOUND_WORDS = 1 << 16

MOST = 255  # counts above are taken as this, which keeps every difference of one or less


def vector(word: str) -> bytes:
    counts = [sum(map(word.count, g)) for g in GROUPS]
    counts.append(len(word) - sum(counts))
    return bytes([min(c, MOST) for c in counts])


def _counts() -> list[Column]:
    """The counts of ``vector`` for column ``word``."""
    size = F.char_length("word")
    counts = [size - F.char_length(F.regexp_replace("word", f"[{g}]", "")) for g in GROUPS]
    rest = size
    for c in counts:
        rest = rest - c
    return [F.least(c, F.lit(MOST)) for c in (*counts, rest)]


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs of all texts, every 97th (by hash) short of a letter."""
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), 0)).alias("run"))
    low = runs.select("doc", F.when(ascii_only, F.lower("run")).otherwise(
        F.translate("run", UPPER, UPPER.lower())).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    cut = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.char_length("run")))
    words = low.select(F.when(h % EDIT_MOD == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n"))


class Trie:
    """The words of a shard by the counts behind its key."""

    def __init__(self, words: dict[str, bytes], depth: int):
        self.vectors = words
        self.depth = depth
        self.root = self._node(list(words.items()), depth)

    def _node(self, items: list[tuple[str, bytes]], depth: int):
        if len(items) <= LEAF_WORDS or depth == len(GROUPS) + 1:
            return [w for w, _ in items]
        below: dict[int, list] = {}
        for item in items:
            below.setdefault(item[1][depth], []).append(item)
        return {count: self._node(part, depth + 1) for count, part in below.items()}

    def near(self, word: str, own: bytes, surplus: int, deficit: int) -> Iterator[str]:
        """Words of the shard one edit from ``word`` and above it in (vector,
        word) order; the budgets are what the key has left."""
        half = (len(word) - 1) // 2  # one edit leaves the first or the last half of the word
        head, tail = word[:half], word[-half:]
        nodes = [(self.root, self.depth, surplus, deficit)]
        while nodes:
            node, depth, surplus, deficit = nodes.pop()
            if type(node) is list:
                for other in [w for w in node if w.startswith(head) or w.endswith(tail)]:
                    if (self.vectors[other], other) > (own, word) and one_edit(word, other):
                        yield other
                continue
            count = own[depth]
            below = node.get(count)
            if below is not None:
                nodes.append((below, depth + 1, surplus, deficit))
            if surplus:
                below = node.get(count + 1)
                if below is not None:
                    nodes.append((below, depth + 1, 0, deficit))
            elif deficit:
                below = node.get(count - 1)
                if below is not None:
                    nodes.append((below, depth + 1, surplus, 0))


def _reached(own: bytes, levels: int) -> Iterator[bytes]:
    """Keys above a word's own that a surplus, then a deficit, lead to."""
    key = own[:levels]
    for i in range(levels):
        if key[i] < MOST:
            more = bytearray(key)
            more[i] += 1
            yield bytes(more)
            for j in range(i + 1, levels):
                if key[j]:
                    more[j] -= 1
                    yield bytes(more)
                    more[j] += 1


VISITS = ["shard", "visitor", "word", "n", "counts"]


def _visits(words: DataFrame, levels: int) -> DataFrame:
    """(shard, visitor, word, n, counts): each word in its own shard, and as a
    visitor in the others that its budget reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = vector(word)
                    rows.append((own[:levels], False, word, n, own))
                    rows.extend((key, True, word, n, own) for key in _reached(own, levels))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], VISITS)

    return words.select("word", "n").mapInArrow(run, "shard binary, visitor boolean, word string, n long, counts binary")


def _levels(words: DataFrame, shard_words: int) -> tuple[int, int]:
    """Levels in the shard key, and the words of the largest shard then. Words
    are counted per prefix in one pass; one number per level reaches the driver."""
    names = [f"c{i}" for i in range(KEY_LEVELS)]
    counted = words.select(*[c.alias(n) for n, c in zip(names, _counts())]).groupBy(*names).agg(F.count("*").alias("n"))
    sizes = (counted.rollup(*names).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
             .groupBy("g").agg(F.max("n").alias("n")).collect())
    largest = {KEY_LEVELS - r["g"].bit_length(): r["n"] or 0 for r in sizes}
    for levels in range(1, KEY_LEVELS):
        if largest.get(levels, 0) <= shard_words:
            return levels, largest.get(levels, 0)
    return KEY_LEVELS, largest.get(KEY_LEVELS, 0)


def _in_blocks(visits: DataFrame, shard_words: int) -> DataFrame:
    """``visits`` with a block per row. The words of a shard above the bound are
    dealt into blocks by hash; whoever searches the shard goes to every block."""
    large = (visits.where(~F.col("visitor")).groupBy("shard").agg(F.count("*").alias("size"))
             .where(F.col("size") > shard_words))
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / shard_words).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks)
    dealt = visits.join(large, "shard", "left").withColumn("own", own).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("shard", "block", (F.col("visitor") | (F.col("block") != F.col("own"))).alias("visitor"), "word", "n", "counts")


NEAR = "word string, n_near long, best_n long, best string"


def _search(levels: int):
    """Rows sorted by shard and block, owners before visitors, to the near words
    of each: their number, and the one of largest n (the smaller among equal)."""

    def flush(found: dict[str, list]) -> pa.RecordBatch:
        rows = [(w, *f) for w, f in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trie = None, None
        words: dict[str, bytes] = {}
        times: dict[str, int] = {}
        found: dict[str, list] = {}

        def meet(word: str, other: str, n: int) -> None:
            f = found.get(word)
            if f is None:
                found[word] = [1, n, other]
            else:
                f[0] += 1
                if n > f[1] or n == f[1] and other < f[2]:
                    f[1], f[2] = n, other

        def search(word: str, n: int, own: bytes, surplus: int, deficit: int) -> None:
            for other in trie.near(word, own, surplus, deficit):
                meet(word, other, times[other])
                meet(other, word, n)

        def built() -> None:
            nonlocal trie
            trie = Trie(words, levels)
            for word, own in words.items():
                search(word, times[word], own, 1, 1)

        for batch in batches:
            for shard, block, visitor, word, n, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, block) != place:
                    if place is not None and trie is None:
                        built()
                    if found:
                        yield flush(found)
                    place, trie = (shard, block), None
                    words, times, found = {}, {}, {}
                if not visitor:
                    words[word], times[word] = own, n
                    continue
                if not words:
                    continue
                if trie is None:
                    built()
                key = own[:levels]
                if key == shard:  # from another block of its own shard
                    search(word, n, own, 1, 1)
                else:  # the way here took the surplus, and the deficit if the sums are equal
                    search(word, n, own, 0, sum(key) != sum(shard))
                if len(found) >= FOUND_WORDS:  # summed up again behind the shuffle
                    yield flush(found)
                    found.clear()
        if place is not None and trie is None:
            built()
        if found:
            yield flush(found)

    return run


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) with a near word;
    best is the near word of largest n, the smaller in code-point order among equal."""
    levels, largest = _levels(words, shard_words)
    visits = _visits(words, levels)
    if largest > shard_words:
        visits = _in_blocks(write_once(visits, "visits"), shard_words)
    else:
        visits = visits.withColumn("block", F.lit(0))
    laid = (visits.select("shard", "block", "visitor", "word", "n", "counts").repartition("shard", "block")
            .sortWithinPartitions("shard", "block", "visitor"))
    parts = laid.mapInArrow(_search(levels), NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last. Each
    round doubles the steps taken, and a form has at least twice the count of
    its word, so few rounds end it."""
    cur = write_once(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        cur = write_once(cur.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = cur.where("moved").limit(1).count()
        cur = cur.select("word", "root")
        if not moved:
            return cur


def spelling_groups(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the letter runs (A-Z lowered, others as they are) of at least
    MIN_LETTERS code points that occur at least MIN_TIMES times; a run whose
    hash with its doc_id is a multiple of EDIT_MOD has lost a letter. form is
    the near word of largest n (ties: smallest in code-point order) if that n is
    at least FORM_FACTOR times the word's, else null; root follows the forms to
    the last. Null texts have no words, a null doc_id hashes as an empty string,
    rows that repeat count each, further columns are ignored, and no documents
    give no rows. A word of any length is one word."""
    words = write_once(word_counts(docs).where(F.col("n") >= MIN_TIMES), "words")
    near = near_words(words, shard_words)
    formed = F.col("best_n") >= FORM_FACTOR * F.col("n")
    table = write_once(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(table.where("form is not null"))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
