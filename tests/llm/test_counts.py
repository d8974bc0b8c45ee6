"""Spelling variants and importance resampling against brute force, token
counts against the library, on small and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import importance, spelling
from logloom.llm.importance import bracket, resample
from logloom.llm.spelling import spelling_groups
from logloom.llm.token_counts import TokenCounter, count_tokens, merge_count

SF_CHECK = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# -- spelling variants


def words_of(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    n = words_of(rows)
    shared = defaultdict(set)
    for w in n:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[k].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if is_near(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted_rows((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_spelling_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    want = brute_groups(pairs(docs))
    assert sum(r[4] for r in want) > 10_000 and any(r[1] for r in want)
    assert sorted_rows(spelling_groups(docs).collect()) == want


def variants():
    """Words of few letters (many share a count vector), chains of forms,
    letters outside a-z, and very long words."""
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        word = "".join(rng.choice("abà×ÿz") for _ in range(rng.randint(4, 7)))
        texts.append((word + " ") * rng.randint(1, 9))
    for i, word in enumerate(["colour", "Color", "colours", "colou", "cOlouts", "coloutz", "x" * 5000, "x" * 5001, "x" * 4999 + "y"]):
        texts.append((word + "-") * 3 * 2 ** i)
    return list(enumerate(texts))


@pytest.mark.parametrize("shard_words", [1 << 14, 3])
def test_spelling_shards_and_blocks(spark, shard_words, monkeypatch):
    monkeypatch.setattr(spelling, "FOUND_WORDS", 5)
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # a form with a form
    assert sorted_rows(spelling_groups(docs, shard_words).collect()) == want


def test_spelling_ties_go_to_the_smaller_word(spark):
    rows = [(1, "boots " * 3 + "books " * 6 + "bolts " * 6 + "bootz " * 6)]
    out = {r.word: r for r in spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out["boots"].form, out["boots"].n_near, out["boots"].form_n) == ("bolts", 3, 6)
    assert out["books"].form is None and out["books"].root == "books"


def test_spelling_of_awkward_rows(spark, awkward, no_documents):
    assert sorted_rows(spelling_groups(awkward).collect()) == brute_groups(pairs(awkward))
    assert spelling_groups(no_documents).collect() == []
    assert spelling_groups(no_documents).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit_and_vectors():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == is_near(a, b)
        diff = [y - x for x, y in zip(spelling.vector(a), spelling.vector(b))]
        if is_near(a, b):
            assert sum(max(d, 0) for d in diff) <= 1 and sum(max(-d, 0) for d in diff) <= 1


# -- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(BPE)


def library_count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, BPE).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = library_count(library, r.text)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 512)


def test_token_counts_of_awkward_rows(awkward, no_documents, library):
    want = [(r.doc_id, len((r.text or "").encode()), (n := library_count(library, r.text)), n > 512) for r in awkward.collect()]
    assert sorted_rows(count_tokens(awkward, BPE).collect()) == sorted_rows(want)
    assert count_tokens(no_documents, BPE).collect() == []


def test_token_counts_of_random_texts(counter, library):
    rng = random.Random(5)
    letters = "aabbcc  \n\t'sdtrvelm12２é数<|>\u0085​ 　😀꟎՘٣"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.3:
            text = text[:7] + "<|endoftext|>" * rng.randint(1, 2) + text[7:]
        assert counter(text) == library_count(library, text), repr(text)


def test_every_character_is_cut_as_the_library_cuts_it(counter):
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}a1{chr(c)}1 {chr(c)}a"
            assert counter._cut(text) == counter._library_chunks(text), hex(c)


def test_a_very_long_run_is_one_chunk(counter, library):
    for text in ("ab" * 20_000, "x" * 30_000, "abcdefghij" * 4000):
        assert counter(text) == library_count(library, text)


def test_equal_ranks_merge_from_the_left():
    ranks = {1 << 32 | 1: (0, 2), 2 << 32 | 1: (1, 3)}
    assert merge_count([1, 1, 1], ranks) == 2  # (1 1) 1, then (2 1)
    assert merge_count([1, 1, 1, 1], ranks) == 2 and merge_count([], ranks) == 0 and merge_count([1], ranks) == 0


def test_the_dictionary_of_chunks_is_bounded(monkeypatch, library):
    from logloom.llm import token_counts

    monkeypatch.setattr(token_counts, "CACHE_BYTES", 60_000)
    counter = TokenCounter(BPE)
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join(str(rng.random()) for _ in range(100)) + " " + "y" * 500
        assert counter(text) == library_count(library, text)
        assert counter.held <= 62_000


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


# -- importance resampling


def features_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, percent=5, min_words=20):
    docs = [(d, *features_of(t)) for d, t in rows]
    every, wanted = Counter(), Counter()
    for _, _, f in docs:
        every.update(f)
    for t in target:
        wanted.update(features_of(t)[1])
    s, t = sum(every.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((every[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for d, n_words, f in docs:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    drawn = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0], r[2], r[1]))
    for i, r in enumerate(drawn[:percent * len(drawn) // 100]):
        r[4] = i + 1
    return sorted_rows(r[:5] for r in out)


def test_resampling_equals_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_resample(pairs(docs), [r.text for r in target.collect()])
    assert sum(r[4] is not None for r in want) > 40
    assert sorted_rows(resample(docs, target).collect()) == want


def test_resampling_of_awkward_rows(spark, awkward, no_documents):
    target = spark.createDataFrame([(1, None, 0), (2, "Alpha beta12 数据 épée straße", 0), (3, "", 0)], "item_id long, text string, rank int")
    for percent, min_words in ((5, 20), (40, 1), (100, 0), (0, 0)):
        want = brute_resample(pairs(awkward), [r.text for r in target.collect()], percent, min_words)
        assert sorted_rows(resample(awkward, target, percent, min_words).collect()) == want
    assert resample(no_documents, target).collect() == []
    want = brute_resample(pairs(awkward), [])
    assert sorted_rows(resample(awkward, target.limit(0)).collect()) == want


def test_resampling_of_equal_scores(spark):
    """A third of the rows are one row repeated: equal ids, texts and scores."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 300 + [(i, text + f" x{i}") for i in range(100, 700)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2 w3",)], "text string")
    for percent in (5, 50, 90):
        assert sorted_rows(resample(docs, target, percent).collect()) == brute_resample(rows, ["w1 w2 w3"], percent)


@pytest.mark.parametrize("half_width", [0.0, 0.002, 0.3])
@pytest.mark.parametrize("sketch", [10, 10_000])
def test_the_bracket_is_validated_or_widened(spark, half_width, sketch):
    rng = random.Random(4)
    scores = [rng.choice([rng.randint(0, 20), rng.randint(-10**6, 10**6), 5]) for _ in range(3000)]
    table = spark.createDataFrame([(x,) for x in scores], "score long").cache()
    for wanted in (1, 150, 1500, 2999, 3000):
        low, high, above = bracket(table, wanted, len(scores), sketch, half_width)
        assert above == (0 if high is None else sum(x > high for x in scores)) < wanted
        inside = sum((low is None or x >= low) and (high is None or x <= high) for x in scores)
        assert above + inside >= wanted


def test_checksums_of_runs_and_of_very_long_words():
    made = importance.Features()
    texts = ["a bb ccc dddd", "é " + "x" * 200 + " y " + "数" * 100 + " end", "", "one", "A-b_C 9"]
    buckets, owner, n_words = made([t.encode() for t in texts])
    for i, text in enumerate(texts):
        n, want = features_of(text)
        assert n_words[i] == n and sorted(buckets[owner == i]) == sorted(want)
    assert [len(x) for x in made([])] == [0, 0, 0] and [len(x) for x in made([b""])] == [0, 0, 1]


def test_bucket_counts_cover_all_rows(spark, awkward):
    n = importance.bucket_counts(awkward).agg(F.sum("n")).first()[0]
    assert n == sum(len(features_of(t)[1]) for _, t in pairs(awkward))
    assert np.array_equal(importance.gains(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)), np.zeros(10_000))
