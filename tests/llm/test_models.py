"""Classifier (held-out accuracy), tokens and packing (exact round trip),
N-best segmentation (all segmentations), neighbours (recall), line alignment."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import ann
from logloom.llm.ann import nearest
from logloom.llm.line_dedup import aligned_blocks, line_dedup, patience_matches
from logloom.llm.packing import SHARD_TOKENS, _powers, _Shard, bm25_pack
from logloom.llm.pieces import PieceModel, decode_ids, encode_nbest
from logloom.llm.quality import fit_ordinal, fit_quality, quality_scores, rated, score_quality

SF_CHECK = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- quality


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    grades = rated(spark.read.parquet(f"{SF_LARGE}/labels.parquet"))
    test = grades.where("doc_id % 3 = 0")
    model = fit_quality(docs, grades.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    out = score_quality(docs.join(test.select("doc_id"), "doc_id"), model).join(test, "doc_id").collect()
    assert len(out) > 100
    right = np.mean([(r.grade == 2) == r.kept for r in out])
    top = np.mean([r.grade == 2 for r in out])
    assert right >= max(0.9, top), (right, top)
    clean = [r.kept for r in out if r.grade == 2]
    assert np.mean(clean) >= 0.97


def test_ordinal_thresholds_order_the_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    rows = np.stack([grades, 100 + rng.integers(0, 50, 400)], axis=1)
    model = fit_ordinal(rows.ravel(), np.full(400, 2), grades, 4)
    expected = [model.at_least(model.score(np.array([g]))).sum() for g in range(4)]
    assert expected == sorted(expected) and expected[3] - expected[0] > 1.5


def test_quality_of_repeated_ids_does_not_follow_the_files(spark):
    rows = [(i % 3, f"word{i % 7} text{i} " * (1 + i % 5)) for i in range(200)]
    grades = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "doc_id long, grade int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [fit_quality(docs.repartition(n, "text"), grades, max_rated=10) for n in (1, 7)]
    assert np.array_equal(models[0].thresholds, models[1].thresholds)
    assert np.array_equal(models[0].score(np.arange(5)), models[1].score(np.arange(5)))


def test_quality_of_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 1), (7, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_scores(awkward, labels)
    assert out.count() == awkward.count()
    assert set(out.columns) == {*awkward.columns, "expected_grade", "p_top"}
    assert quality_scores(no_documents, labels).collect() == []
    assert quality_scores(awkward, labels.limit(0)).where("kept").count() == awkward.count()


# -- tokens and packing


def packed(docs, **more):
    pieces = bm25_pack(docs, BPE, **more).collect()
    texts, rows = defaultdict(list), docs.collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    for r in rows:
        texts[r.doc_id].append(whole.encode(r.text or "", add_special_tokens=False).ids + [2])
    return pieces, texts


def test_packing_round_trip(awkward):
    window = 256
    pieces, texts = packed(awkward, window=window)
    whole = {k: Counter(map(tuple, v)) for k, v in texts.items()}
    rebuilt, sequences, open_docs = defaultdict(list), defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        sequences[p.sequence_id].append((p.offset, p.length))
        open_docs[p.doc_id].append((p.doc_tokens, p.start, tuple(ids.tolist())))
    for doc_id, parts in open_docs.items():
        for size, group in itertools.groupby(sorted(parts), key=lambda p: p[0]):
            group = list(group)
            by_start = defaultdict(list)
            for _, start, ids in group:
                by_start[start].append(ids)
            for head in by_start.pop(0):
                ids = list(head)
                while len(ids) < size:
                    ids += by_start[len(ids)].pop()
                rebuilt[doc_id].append(tuple(ids))
            assert not any(by_start.values())
    assert {k: Counter(v) for k, v in rebuilt.items()} == whole
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_packing_puts_neighbours_together(spark):
    rng = random.Random(2)
    topics = [[f"word{t}x{i}" for i in range(30)] for t in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(40))) for i in range(80)]
    pieces = bm25_pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BPE, window=1024).collect()
    same = [len({p.doc_id % 4 for p in group}) for _, group in itertools.groupby(
        sorted(pieces, key=lambda p: p.sequence_id), key=lambda p: p.sequence_id)]
    assert np.mean(same) < 2.5
    assert SHARD_TOKENS >= 4096


def test_packing_fills_a_window_from_all_neighbours_and_terms():
    idf = np.ones(1 << 16)
    idf[2] = 0.0
    docs = [np.array([100 + i % 2, 1000 + i, 2000 + i, 3000 + i, 2], "<u2") for i in range(400)]
    first = next(_Shard(docs, idf, 5.0).windows(900))
    assert [d for d, _, _ in first] == list(range(0, 360, 2))
    idf[1000:1040] = 9.0
    docs = [np.array([*range(1000, 1040), 7, 2], "<u2")] + [np.array([50 + i, 2], "<u2") for i in range(9)] + [np.array([7, 2], "<u2")]
    assert _Shard(docs, idf, 5.0).neighbours(0, np.arange(11) == 0, 900).tolist() == [10]


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.choice([*range(100, 130), *range(1000, 1400)], rng.integers(1, 60), p=[1 / 60] * 30 + [1 / 800] * 400), 2)
            .astype("<u2") for _ in range(150)]
    docs[40] = docs[7]
    idf, mean = np.zeros(1 << 16), np.mean([len(d) for d in docs])
    idf[100:1400] = rng.uniform(0.1, 8, 1300)
    shard, used = _Shard(docs, idf, mean), np.zeros(len(docs), bool)
    for seed in rng.permutation(len(docs)).tolist():
        used[seed] = True
        terms, score = set(docs[seed].tolist()) - {2}, {}
        for i, d in enumerate(docs):
            if used[i]:
                continue
            tf = Counter(d.tolist())
            norm = 1.2 * (0.25 + 0.75 * len(d) / mean)
            score[i] = sum(idf[t] * tf[t] * 2.2 / (tf[t] + norm) for t in terms & set(tf))
        found = shard.neighbours(seed, used, 1 << 40).tolist()
        assert sorted(found) == sorted(i for i, x in score.items() if x > 0)
        got = [score[i] for i in found]
        assert np.allclose(got, sorted(got, reverse=True), rtol=1e-5)
        few = shard.neighbours(seed, used, 50).tolist()
        assert few == found[:len(few)]
    assert len(shard.live) < 50


@pytest.fixture(scope="module")
def many_shards(spark):
    """Topics, copies of one text, empty texts, repeated rows, null ids, a text longer than a shard."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = rng.sample(sorted(w for w in Tokenizer.from_file(BPE).get_vocab() if len(w) > 5 and w.isascii() and w.isalpha()), 150)
    topics = [words[t::5] for t in range(5)]
    rows = [(i, " ".join(rng.choice(topics[i % 5]) for _ in range(rng.randint(5, 60)))) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(90)] + [(400 + i, "" if i % 2 else None) for i in range(40)]
    rows += [rows[7]] * 12 + [(None, rows[8][1]), (None, "no id here")]
    rows.append((900, " ".join(rng.choice(topics[2]) for _ in range(3000))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def windows_of(pieces):
    found = defaultdict(list)
    for p in pieces:
        found[p.sequence_id].append((p.offset, p.doc_id, p.start, p.length, p.ids_crc32))
    return Counter(tuple(sorted(x, key=lambda r: r[0])) for x in found.values())


def test_packing_does_not_depend_on_partitions(many_shards):
    kinds = [packed(many_shards.repartition(n, "text") if n > 1 else many_shards.coalesce(1), window=512, shard_tokens=2000)[0]
             for n in (1, 40)]
    assert windows_of(kinds[0]) == windows_of(kinds[1])
    shards = {p.sequence_id >> 32 for p in kinds[0]}
    assert len(shards) >= 8
    # All ids once, windows of one length but for the last ones of a shard.
    sizes = defaultdict(int)
    for p in kinds[0]:
        sizes[p.sequence_id] += p.length
    short = [n for n in sizes.values() if n < 512]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 9 * len(shards)
    assert sum(p.length for p in kinds[0] if p.doc_id == 900) == next(p.doc_tokens for p in kinds[0] if p.doc_id == 900) > 2000


def test_packing_finds_related_documents_in_other_files(many_shards):
    pieces = bm25_pack(many_shards.repartition(16, "doc_id"), BPE, window=512, shard_tokens=2000).collect()
    held = defaultdict(Counter)
    for p in pieces:
        if p.doc_id is not None and p.doc_id < 150:
            held[p.sequence_id >> 32][p.doc_id % 5] += p.length
    # Most of what shares a shard shares a topic: by place alone it would be a fifth.
    assert sum(max(c.values()) for c in held.values()) > 0.6 * sum(sum(c.values()) for c in held.values())


def test_a_tokenizer_that_joins_across_spaces_is_refused():
    from logloom.llm.tokens import ChunkIds

    assert ChunkIds(BPE).direct
    with pytest.raises(ValueError):
        ChunkIds(BPE.replace("word_bpe_49k", "byte_bpe_50k"))


def test_ids_are_the_whole_tokenizers():
    from tokenizers import Tokenizer

    from logloom.llm.tokens import ChunkIds

    rng, whole, ours = random.Random(6), Tokenizer.from_file(BPE), ChunkIds(BPE)
    letters = "abIT\u0307\u0301!?:; Z.\n\n  ,é中ßİſ'\t\r  🙂0-<|"
    texts = ["", " ", "\n"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [x + rng.choice(["<|endoftext|>", "<|EndOfText|>"]) + x for x in texts[:100]]
    want = [np.array(e.ids, "<u2").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x for at in range(0, len(texts), 50) for x in ours(texts[at:at + 50])] == want
    assert ours([]) == []


def test_powers_cover_every_id():
    for total in (1, 2, 3, 100, 255):
        lists = list(_powers([(0, 0, total // 2), (1, 5, total - total // 2)], 256))
        assert sum(n for part in lists for _, _, n in part) == total
        assert all(sum(n for _, _, n in part).bit_count() == 1 for part in lists)


def test_packing_of_nothing(no_documents):
    assert bm25_pack(no_documents, BPE).collect() == []


# -- pieces


@pytest.fixture(scope="module")
def model():
    return PieceModel(PIECES)


def all_segmentations(model, s):
    if not s:
        return [(0.0, ())]
    out = []
    for end in range(1, len(s) + 1):
        arc = model.arcs.get(s[:end])
        arcs = [((arc[0],), arc[1])] if arc else []
        if end == 1 and not arc:
            arcs = [(tuple(model.byte_ids[b] for b in s[0].encode()), model.unknown_score)]
        for ids, score in arcs:
            out += [(score + more, ids + rest) for more, rest in all_segmentations(model, s[end:])]
    return out


@pytest.mark.parametrize("text", ["hello you", "a  b", "thetion", "né\n", "数据é☃x", "abab,ab.", "a", " the"])
def test_nbest_is_the_best_of_all(model, text):
    found = model.nbest(text, 6)
    every = sorted(all_segmentations(model, model.normalize(text)), reverse=True)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in every[:6]])
    by_ids = {ids: s for s, ids in every}
    ids = [tuple(memoryview(i).cast("I").tolist()) for _, i in found]
    assert len(set(ids)) == len(ids)
    assert [by_ids[i] for i in ids] == pytest.approx([s for s, _ in found])
    assert all(model.decode(i) == text for _, i in found)


def test_encode_and_decode_documents(awkward, no_documents):
    out = encode_nbest(awkward, PIECES, 3)
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.round_trip and r.scores == sorted(r.scores, reverse=True) and 1 <= len(r.ids) <= 3
        assert r.n_pieces == len(r.ids[0])
    texts = decode_ids(out.select("doc_id", F.col("ids")[0].alias("ids")), PIECES).collect()
    assert Counter(r.text for r in texts) == Counter(r.text or "" for r in awkward.collect())
    assert encode_nbest(no_documents, PIECES).collect() == []


# -- neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    v = (centres[rng.integers(0, 20, 6000)] + 0.3 * rng.standard_normal((6000, 24))).astype(np.float32)
    v[1000:3000] = v[0]  # a third of all rows is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(7000, None), (7100, [0.0] * 24), (7200, [float("nan")] * 24), (7300, [None] * 24), (7400, [float("inf")] * 24),
             (7500, []), (None, v[5].tolist()), (7600, [1.0])]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(by) == list(range(0, 6000, 100))
    hits = 0
    for q, got in by.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(6000), d))[:10]
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        assert np.allclose([g[2] for g in got], [d[g[1]] for g in got], rtol=1e-12)
        hits += len({g[1] for g in got} & set(best.tolist()))
        if d[best[-1]] == 0:
            assert [g[1] for g in got] == best.tolist()
    assert hits / (10 * len(by)) >= 0.9


def test_neighbours_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0]), (100, [1.0, 0.5])]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    twice = nearest(spark.createDataFrame(rows + rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert twice == out
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_neighbours_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    v = np.stack([rows[i] for i in ids])
    hits = total = 0
    out = defaultdict(set)
    for r in nearest(table).collect():
        out[r.query_id].add(r.vec_id)
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - rows[q]) ** 2).sum(1))
        best = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits, total = hits + len(out[q] & set(best)), total + 10
    assert hits / total >= 0.9


def test_neighbours_recall_over_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 40)
    rng = np.random.default_rng(11)
    v = rng.standard_normal((12_000, 64))  # 300 lists, every direction alike
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = defaultdict(set)
    for r in nearest(table.repartition(4), queries_every=200).collect():
        out[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 200):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(out[q] & set(np.argsort(d)[:10].tolist()))
    assert len(out) == 60 and hits / 600 >= 0.9


# -- lines


def test_patience_matches_are_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [[rng.randint(0, 9) for _ in range(rng.randint(0, 25))] for _ in range(2)]
        found = patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    assert patience_matches(list("abcdef"), list("xbcydf")) == [(1, 1), (2, 2), (3, 4), (5, 5)]
    assert aligned_blocks([(0, [0], [5], 60), (1, [1], [6], 60), (2, [9], [7], 60)], 100) == [(5, 2)]


def test_line_dedup_by_hand(spark):
    line = lambda k: f"line number {k} of some length, {k * 7919 % 1000}"
    boiler = "a line that every document has at its top, whatever it is about"
    docs = [[boiler] + [line(100 * d + k) for k in range(8)] for d in range(30)]
    docs[3] = docs[1]  # a copy
    docs[7] = [boiler, line(9000)] + docs[2][3:7] + [line(9001)]  # a block of another one
    docs[9] = [line(9100), docs[2][4], line(9101)]  # one short line in common
    docs += [[boiler, *docs[0][1:5], line(10_000 + d), *docs[0][5:]] for d in range(40)]  # a group of near copies
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)] + [(900, None), (901, ""), (None, "\n".join(docs[4]))]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rare=5).collect()}
    text = lambda lines: "\n".join(lines)
    assert out[1].text == text(docs[1]) and out[1].n_removed == 0
    assert out[3].text == "" and out[3].n_removed == 9 and out[3].n_lines == 9
    assert out[7].text == text([boiler, line(9000), line(9001)])
    assert out[9].text == text(docs[9]) and out[5].text == text(docs[5])
    for d in range(30, 70):
        assert out[d].text == text([line(10_000 + d - 30)]), d
    assert out[900].text == "" and out[901].text == "" and out[None].text == ""


def test_line_dedup_of_one_line_in_150_documents(spark):
    passage = "one passage without any line feed, " * 4
    rows = [(i, f"a line of document {i} alone\n{passage}\nand its end, number {i}") for i in range(150)]
    rows += [(i, passage) for i in range(150, 300)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out[0].n_removed == 0 and all(out[i].n_removed == 1 for i in range(1, 300))
    assert all(out[i].text == "" for i in range(150, 300))


def test_line_dedup_of_a_block_whose_lines_have_older_holders(spark):
    block = [f"line {k} of a block that has about fifty characters" for k in range(3)]
    own = lambda d: [f"document {d} has this line and no other one has it", f"{d} says that too, and again it is alone"]
    docs = [[*own(d), block[d], *own(d + 50)] for d in range(3)] + [[*own(d), *block, *own(d + 50)] for d in (3, 4)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [out[i].n_removed for i in range(5)] == [0, 0, 0, 0, 3]
    assert out[4].text == "\n".join(own(4) + own(54))


def test_line_dedup_of_short_lines(spark):
    verse = [f"short {k}" for k in range(40)]
    long = "a line of the block that is long enough to reach one hundred characters by itself, which it does here"
    rows = [(0, verse), (1, verse), (2, ["mine", long, "", "x", long + "!"]), (3, ["other", "x", long, "", "x", long + "!", "end"])]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(
        [(i, "\n".join(x)) for i, x in rows], "doc_id long, text string").coalesce(1)).collect()}
    assert [out[i].n_removed for i in range(4)] == [0, 40, 0, 4]
    assert out[1].text == "" and out[3].text == "other\nx\nend"


def test_line_dedup_of_awkward_rows(awkward, no_documents):
    assert line_dedup(awkward).count() == awkward.count()
    assert line_dedup(no_documents).collect() == []
