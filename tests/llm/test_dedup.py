import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from evenkeel.llm import exact_dedup, simhash


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(ids, fps):
    f = np.array(fps, dtype=np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= 2) + k + 1:
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(ids[k])
    least = {g: min((i for i in members if i is not None), default=None) for g, members in groups.items()}
    return [least[find(k)] for k in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one TWO", "a b c", "a b c d a b c d", "é É Ü straße x", "w " * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == naive_fingerprint(text)


def test_every_linked_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    for flips in (1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(x)))
        rx, ax, home_x = simhash.anchors_of(x)
        ry, ay, home_y = simhash.anchors_of(y)
        for k in range(len(x)):
            hx, hy = set(ax[(rx == k) & home_x]), set(ay[(ry == k) & home_y])
            assert len(hx) == len(hy) == 1
            assert hx & set(ay[ry == k]) or hy & set(ax[rx == k])
    assert len(rx) / len(x) < 70


@pytest.mark.parametrize("cell", [simhash.CELL, 1])
def test_components_against_all_pairs(spark, corpus, cell):
    got = simhash.near_duplicates(corpus, cell).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    got.sort(key=lambda r: r["doc_id"])
    want = [naive_fingerprint(texts[r["doc_id"]]) for r in got]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in want]
    assert [r["component_id"] for r in got] == naive_components([r["doc_id"] for r in got], want)


def test_chain_of_near_fingerprints_is_one_component(spark):
    chain, at = [], 0
    for k in range(0, 40, 2):
        at ^= 0b11 << k
        chain.append((k, at))
    far = [(100, at ^ 0b111 << 50), (101, -1)]
    prints = spark.createDataFrame(chain + far, "doc_id bigint, fp bigint")
    got = {r["fp"]: r["component_id"] for r in simhash.component_ids(prints, cell=3).collect()}
    assert {got[f] for _, f in chain} == {0}
    assert [got[f] for _, f in far] == [100, 101]


def test_large_group_hands_on_a_forest_only():
    base = np.array([0, *(1 << k for k in range(23, 46))], dtype=np.int64)
    found = []
    simhash._forest(base, len(base), found)
    assert len(found) == len(base) - 1


def test_near_duplicates_messy(messy, nothing):
    got = simhash.near_duplicates(messy).collect()
    rows = messy.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fps = [naive_fingerprint(r["text"]) for r in rows]
    want = sorted(map(str, zip([r["doc_id"] for r in rows], [f"{f:016x}" for f in fps], naive_components([r["doc_id"] for r in rows], fps), strict=True)))
    assert sorted(str(tuple(r)) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_first_of_each(messy, nothing):
    kept = simhash.first_of_each(messy)
    assert kept.columns == messy.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    fps = {naive_fingerprint(r["text"]) for r in messy.select("text").collect()}
    # all pairs: no two fingerprints of these texts are linked
    assert all((a ^ b).bit_count() > simhash.THRESHOLD for a in fps for b in fps if a != b)
    assert len(rows) == len({naive_fingerprint(t) for _, t in rows}) == len(fps) == 9
    assert sum(i == 6 for i, _ in rows) == 1
    assert {i for i, _ in rows} >= {1, 3, 7, 10, None}
    assert simhash.first_of_each(nothing).count() == 0


def test_first_of_each_keeps_unlinked_texts_of_equal_or_no_ids(spark):
    bridge, corn, ship, bread, night = "the old bridge by the mill was closed", "corn prices fell for a third week", "no ship had left port since monday", "bread rises best in a warm kitchen", "stars were seen over all the hills"
    rows = [(None, bridge), (None, corn), (None, corn), (9, ship), (9, bread), (9, bread), (None, night), (4, night)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, bridge), (None, corn), (9, ship), (9, bread), (4, night)]))


@pytest.mark.parametrize("heavy", [2, 64])
def test_exact_groups_against_a_dictionary(messy, corpus, heavy):
    for docs in (messy, corpus):
        rows = docs.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[r["text"] or ""].append(r["doc_id"])
        got = exact_dedup.exact_groups(docs, heavy_rows=heavy).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r["text_sha256"]].append(r)
        assert len(by) == len(groups)
        for text, ids in groups.items():
            mine = by[hashlib.sha256(text.encode()).hexdigest()]
            keep = max((i for i in ids if i is not None), default=None)
            assert sorted(map(str, (r["doc_id"] for r in mine))) == sorted(map(str, ids))
            assert {r["keep_id"] for r in mine} == {keep} and {r["group_size"] for r in mine} == {len(ids)}
            assert [r["doc_id"] for r in mine if r["kept"]] == [keep]


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_frequent_digests_are_found(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    digests = exact_dedup.digest_table(docs)
    found = exact_dedup.heavy_digests(digests, tracked=64).collect()
    assert [(r["group_size"], r["top"]["doc_id"]) for r in found] == [(1000, 2997)]
