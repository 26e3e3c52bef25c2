from collections import Counter

import numpy as np

from loomgraph.llm import lm_scoring as lm
from loomgraph.llm import queries
from loomgraph.llm.words import utf8, word_hashes


def test_rare_words_have_their_share_of_the_bucket(spark):
    net = lm.Network(classes=3, members=4, buckets=3, dims=5)
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in draw.zipf(1.4, 60) % 200) for _ in range(40)] + ["", None, "once", "once once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain = {r.doc_id: r for r in lm.score_documents(docs, net).collect()}
    own = {r.doc_id: r for r in lm.score_words(docs, net).collect()}
    import pyarrow as pa

    hashes = {w: int(word_hashes(*utf8(pa.array([w])))[0][0]) for t in texts if t for w in t.split()}
    n = Counter(w for t in texts if t for w in t.split())
    top = set(sorted(n, key=lambda w: (-n[w], np.uint64(hashes[w]).astype(np.int64)))[: net.tokens - net.buckets - 1])
    bucket, once = Counter(), Counter()
    key = lambda w: (hashes[w] >> 40) % net.buckets
    for w in n:
        if w not in top:
            bucket[key(w)] += n[w]
            once[key(w)] += n[w] == 1
    new = {b: (once[b] + 1) / (bucket[b] + 2) for b in bucket}
    assert len(own) == len(texts)
    for k, t in enumerate(texts):
        words = [w for w in (t or "").split() if w not in top]
        mine, here, want = Counter(words), Counter(map(key, words)), 0.0
        for w in words:
            b, others = key(w), n[w] - mine[w]
            want += np.log((1 - new[b]) * others / (bucket[b] - here[b])) if others else np.log(new[b]) - (len(w) + 1) * np.log(32)
        assert abs(own[k].log_likelihood - plain[k].log_likelihood - want) < 0.01
        assert own[k].n_tokens == len((t or "").split()) and (own[k].per_token is None) == (own[k].n_tokens == 0)


def test_invented_words_score_below_known_rare_ones(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [" ".join(f"f{k}" for k in draw.permutation(900)) for _ in range(60)] + [" ".join(f"r{k}" for k in draw.permutation(200)) for _ in range(20)] + [" ".join(f"x{k}y" for k in range(200))]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.per_token for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect()}
    assert min(got[k] for k in range(60, 80)) > got[80] + 2


def test_texts_that_occur_twice_score_above_those_that_occur_once(spark):
    draw = np.random.default_rng(3)
    text = lambda k: " ".join(f"c{x}" if x < 60 else f"own{k}_{x}" for x in draw.integers(0, 90, 80))
    texts = [text(k) for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:30])], "doc_id long, text string")
    for known in (50, lm.KNOWN):
        got = {r.doc_id: r.per_token for r in lm.score_words(docs, lm.Network(classes=8, members=8, buckets=4, dims=4), known=known).collect()}
        assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 120)) and all(abs(got[k] - got[1000 + k]) < 1e-5 for k in range(30))
