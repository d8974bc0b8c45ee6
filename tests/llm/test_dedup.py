"""The three operators on equal and similar texts against brute force."""

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from logloom.llm import suffix_dedup as sd
from logloom.llm.common import components
from logloom.llm.exact_dedup import exact_dedup
from logloom.llm.simhash import simhash_components


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).collect()]


# -- exact de-duplication


def exact_by_hand(rows):
    groups = {}
    for doc_id, text, rid in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, rid, doc_id))
    out = {}
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(body.encode()).hexdigest())
    return out


def exact_of(df, block):
    return {r.rid: (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, block).collect()}


def test_exact_dedup_by_hand(awkward):
    expected = exact_by_hand(rows_of(awkward))
    assert exact_of(awkward, 4096) == expected


def test_exact_dedup_many_levels_of_pairs(awkward):
    assert exact_of(awkward, 5) == exact_by_hand(rows_of(awkward))


def test_exact_dedup_one_large_group(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    out = exact_dedup(df, 8)
    assert out.where("kept").count() == 2001
    assert out.where("group_size = 1000").select("keep_id").distinct().collect() == [(0,)]


def test_exact_dedup_of_nothing(no_documents):
    assert exact_dedup(no_documents).collect() == []


# -- SimHash


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, bits):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_by_hand(awkward):
    rows = rows_of(awkward)
    fps = [fingerprint_by_hand(t) for _, t, _ in rows]
    roots = components_by_hand(fps, 4)
    least = {}
    for (doc_id, _, _), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = {rid: (doc_id, f"{fp:016x}", least.get(root)) for (doc_id, _, rid), fp, root in zip(rows, fps, roots)}
    out = simhash_components(awkward).collect()
    assert {r.rid: (r.doc_id, r.fingerprint, r.component_id) for r in out} == expected
    stands = [r.keep_rid for r in out if r.rid == r.keep_rid]
    assert len(stands) == len(set(roots))


def test_simhash_links_of_close_fingerprints(spark):
    """Chains, a dense cell over several blocks, and values with the top bit set."""
    from logloom.llm.simhash import fingerprint_links

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(30):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    dense = int(base[0])
    fps.update(dense ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block=32)
    found = {r.node: r.component for r in components(links).collect()}
    got, want = {}, {}
    for x, r in zip(signed, components_by_hand(fps, 4)):
        got.setdefault(found.get(x, x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(no_documents):
    assert simhash_components(no_documents).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1201)}


# -- repeated byte strings


def removed_by_hand(rows):
    seen, out = set(), {}
    for doc_id, text, rid in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for j in range(len(data) - sd.LENGTH + 1):
            if data[j:j + sd.LENGTH] in seen:
                gone[j:j + sd.LENGTH] = True
            seen.add(data[j:j + sd.LENGTH])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        out[rid] = (doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=repr)


def suffix_of(df):
    out = sd.suffix_dedup(df).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr)


def test_suffix_dedup_by_hand(awkward):
    assert suffix_of(awkward) == removed_by_hand(rows_of(awkward))


def test_suffix_dedup_over_many_slots(spark, awkward):
    """Runs of equal names and strings that cross many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert suffix_of(awkward) == removed_by_hand(rows_of(awkward))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_string_has_a_place_within_it():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 100, 5000, dtype=np.uint8), np.full(1500, 97, np.uint8), np.zeros(99, np.uint8),
             np.zeros(0, np.uint8), rng.integers(97, 123, 3 * sd.CHUNK + 17, dtype=np.uint8), np.zeros(100, np.uint8)]
    of, _, _, _, place, lo, hi = (np.concatenate(c) for c in zip(*sd.places_of(texts)))
    assert sorted(set(of.tolist())) == [0, 1, 4, 5]
    for k in (0, 1, 4, 5):
        p, a, b = place[of == k], lo[of == k], hi[of == k]
        assert a[0] == 0 and b[-1] == len(texts[k]) - sd.LENGTH and (a[1:] == b[:-1] + 1).all()
        assert (p >= b).all() and (p + sd.GRAM <= a + sd.LENGTH).all()


def test_suffix_dedup_of_nothing(no_documents):
    assert sd.suffix_dedup(no_documents).collect() == []
