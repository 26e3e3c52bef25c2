import re

import numpy as np
import pytest

from loomgraph.llm import near_dedup as nd
from loomgraph.llm.words import shingle_sets, utf8, word_hashes

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sets_of(text, size):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [(i, sets_of(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = dict(sets)
    place = {i: k for k, (i, _) in enumerate(sets)}
    by = {}
    for i, s in sets:
        for x in s:
            by.setdefault(x, []).append(place[i])
    by = {x: np.array(v) for x, v in by.items()}
    seen = set()
    for i, s in sets:  # every pair that shares a shingle, however many documents have it
        if s:
            common = np.bincount(np.concatenate([by[x] for x in s]), minlength=len(sets))
            seen.update((i, sets[k][0]) for k in np.flatnonzero(common) if k > place[i])
    for a, b in seen:
        common = len(at[a] & at[b])
        if 100 * common >= percent * (len(at[a]) + len(at[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(at[i]), root(i), root(i) == i) for i, _ in rows}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_whole_table_against_brute_force(spark, size, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(nd.near_duplicates(docs, size, percent)) == brute(rows, size, percent)


def test_chain_of_near_copies_needs_later_rounds(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):  # neighbours differ by one word, the ends by forty
        text = list(base)
        for j in range(k):
            text[j * 5] = f"x{j}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join([f"w{j}" for j in range(60)] + [f"own{k}_{j}" for j in range(60)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (None, "one two", "f"), (6, "one", "g"), (7, "two one", "h"), (5, "one TWO", "e"), (8, "É e é", "i"), (9, "é e é", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "'x' as bands", "1 as component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)], key=str)
    kept = nd.keep_one(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, 9, None]
    assert nd.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_repeated_rows_of_one_document_stay_once(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nd.keep_one(df, 3, 85).collect()) == [1, 2]


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], draw.integers(0, 1 << 62, 200).astype(np.uint64)]))
    one = a[:1]
    s = nd.sketches([a, b, one, a.copy()], 512)
    assert (s != ~np.uint64(0)).all()
    assert (s[0] == s[3]).all()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - truth) < 0.08


def test_word_hashes_over_block_borders():
    import pyarrow as pa

    texts = ["ab cd " * 300_000, None, "", " x ", "long" * 400_000 + " tail", "AB cd"]
    words, at = word_hashes(*utf8(pa.array(texts)))
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    assert words[0] == words[at[5]]
    assert len(np.unique(words)) == 5
    assert len(shingle_sets(words, at, 3)[0]) == 2


def test_hot_copies_hubs_and_clashing_columns(spark, monkeypatch):
    from loomgraph import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5,))
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base)) for k in range(60)] + [(100 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(40)] + [(200 + k, f"alone {k} with words of its own") for k in range(20)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)
    odd = df.selectExpr("*", "1 as __gone", "2 as __turn", "3 as at", "4 as row", "5 as n_shingles")
    kept = nd.keep_one(odd.unionByName(odd.selectExpr("cast(null as long) as doc_id", "text", "__gone", "__turn", "at", "row", "n_shingles")), 3, 85)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    want = sorted(d for d, (_, _, k) in brute(rows, 3, 85).items() if k)
    assert sorted(i for i in ids if i is not None) == want
    # of the rows without an id one more stays per group, and all that have no words
    assert sum(i is None for i in ids) == len(want)


def test_very_long_texts(spark):
    long = " ".join(f"t{k % 5000}u{k % 7}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 200_000), (4, long.upper())]
    assert result(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == brute(rows, 3, 85)
