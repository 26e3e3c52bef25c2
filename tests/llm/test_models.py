import re
import zlib

import numpy as np
from pyspark.sql import Row

import corpus_pipeline
from loomgraph.llm import lm_scoring as lm
from loomgraph.llm import quality
from tests.llm.test_native import water
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import WORDS, check_packing, whole

SF, WIDE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_gradient_is_that_of_the_log_likelihood():
    net = lm.Network(classes=3, members=4, buckets=3, dims=5, radius=2)
    draw = np.random.default_rng(4)
    weights = [w.astype(np.float64) * 5 for w in net.first()]
    ids, at = draw.integers(1, 12, 40).astype(np.uint16), np.array([0, 13, 13, 14, 40])
    targets, contexts = lm.windows(ids, at, 2)
    assert contexts[0].tolist() == [0, 0, *ids[1:3]] and contexts[13].tolist() == [0, 0, 0, 0] and contexts[39].tolist() == [*ids[37:39], 0, 0]
    loss = lambda ws: -lm.log_probabilities(net, ws, targets, contexts).mean()
    moments = [np.zeros_like(w) for w in weights]
    lm.train_step(net, [w.copy() for w in weights], moments, targets, contexts)
    for k, w in enumerate(weights):
        for _ in range(4):
            place = tuple(draw.integers(0, n) for n in w.shape)
            up, down = [x.copy() for x in weights], [x.copy() for x in weights]
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(abs(slope) - np.sqrt(moments[k][place])) < 1e-4


def test_probabilities_sum_to_one():
    net = lm.Network(classes=3, members=4, buckets=3, dims=5)
    context = np.array([[1, 2, 3, 4]])
    total = sum(np.exp(lm.log_probabilities(net, net.first(), np.array([t]), context))[0] for t in range(12))
    assert abs(total - 1) < 1e-5


def slow_log_probability(net, weights, ids, k):
    """log P of one token, by loops over one dimension at a time."""
    table, by_side, bias, outer, outer_bias, inner, inner_bias = (w.astype(np.float64) for w in weights)
    hidden = []
    for d in range(net.dims):
        total = bias[d]
        for j, step in enumerate([s for s in range(-net.radius, net.radius + 1) if s]):
            near = ids[k + step] if 0 <= k + step < len(ids) else 0
            total += table[near][d] * by_side[j][d]
        hidden.append(np.tanh(total))
    kind, member = divmod(int(ids[k]), net.members)
    out = [sum(hidden[d] * outer[d][c] for d in range(net.dims)) + outer_bias[c] for c in range(net.classes)]
    own = [sum(hidden[d] * inner[kind][d][m] for d in range(net.dims)) + inner_bias[kind][m] for m in range(net.members)]
    return out[kind] - np.log(np.exp(out).sum()) + own[member] - np.log(np.exp(own).sum())


def test_training_helps_and_orders_documents(spark):
    shuffled = spark.createDataFrame([(1, "the of and to"), (2, None), (3, ""), (4, " \n"), (None, "the"), (1, "the of and to")], "doc_id long, text string").selectExpr("*", "'i' as ids")
    got = sorted(((r.doc_id, r.n_tokens, r.per_token) for r in lm.score_documents(shuffled).collect()), key=str)
    assert [x[:2] for x in got] == [(1, 4), (1, 4), (2, 0), (3, 0), (4, 0), (None, 1)]
    assert got[0][2] == got[1][2] and got[2][2] is None
    assert lm.score_documents(shuffled.limit(0)).count() == 0


def test_the_network_beats_counting_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    hold = "crc32(cast(doc_id as string)) % 10 = 0"
    model, _ = lm.learn(docs.where(f"not ({hold})"))
    rest = lm._encoded(lm._typed(docs.where(hold)), model.net, model.vocabulary)
    found = lm.score(rest, model, shares=False).selectExpr("sum(log_likelihood) as l", "sum(n_tokens) as n").first()
    counts = model.vocabulary.counts + 1
    table = np.log(counts / counts.sum())
    unigram = sum(table[np.frombuffer(bytes(r.ids), "<u2")].sum() for r in rest.select("ids").collect())
    assert found.l / found.n > unigram / found.n + 0.3
    # words that the corpus lacks are scored too
    assert lm.score_others(spark.createDataFrame([(1, "zzqx the")], "doc_id long, text string"), model).first().n_tokens == 2


def test_whole_table_against_a_slow_forward_pass_whatever_the_partitions(spark):
    net = lm.Network(classes=8, members=8, buckets=9, dims=5, batch=256)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "substring_index(text, ' ', 60) as text")
    model, encoded = lm.learn(docs, net)
    got = {r.doc_id: r for r in lm.score(encoded, model).collect()}
    texts = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2") for r in encoded.collect()}
    counts = {}
    words = {r.doc_id: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in docs.collect()}
    for own in words.values():
        for w in own:
            counts[w] = counts.get(w, 0) + 1
    by_id = {}
    for doc, ids in texts.items():
        for w, i in zip(words[doc], ids, strict=True):
            by_id.setdefault(int(i), {})[w] = counts[w]
    rare = net.tokens - net.buckets
    assert all(len(v) == 1 for i, v in by_id.items() if i < rare)
    for doc, ids in texts.items():
        want, own, own_bucket = 0.0, {}, {}
        for w, i in zip(words[doc], ids, strict=True):
            own[w] = own.get(w, 0) + 1
            own_bucket[int(i)] = own_bucket.get(int(i), 0) + 1
        for k, w in enumerate(words[doc]):
            want += slow_log_probability(net, model.weights, ids, k)
            if (i := int(ids[k])) >= rare:
                every = sum(by_id[i].values())
                new = (sum(n == 1 for n in by_id[i].values()) + 1) / (every + 2)
                others = counts[w] - own[w]
                want += np.log((1 - new) * others / max(1, every - own_bucket[i])) if others else np.log(new) - (len(w.encode()) + 1) * np.log(32)
        assert abs(got[doc].log_likelihood - want) < 1e-3 * max(1, len(ids))
    for parts in (1, 8, 32):
        again = {r.doc_id: r.per_token for r in lm.score_words(docs.repartition(parts), net).collect()}
        assert all(again[d] is None if got[d].per_token is None else abs(again[d] - got[d].per_token) <= 2e-6 for d in got)


def test_words_beyond_the_known_ones_are_looked_up(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    few, many = ({r.doc_id: r.log_likelihood for r in lm.score_words(docs, lm.Network(classes=4, members=8, buckets=5, dims=3), known=k).collect()} for k in (100, 1 << 20))
    assert all(abs(few[d] - many[d]) < 0.01 + 1e-4 * abs(many[d]) for d in many)


def test_one_row_copied_many_times_is_spread_over_shards(spark):
    copies = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'the same text in every row of it' as text")
    encoded = lm._encoded(lm._typed(copies), lm.Network(), lm.vocabulary(lm.count_words(copies), lm.Network()))
    texts, shards = lm.dealt(encoded, 3)
    rows = texts.collect()
    assert len(rows) == min(5000, 3 * shards) and sum(r.times for r in rows) == 5000 and max(r.times for r in rows) - min(r.times for r in rows) <= 1
    long = spark.createDataFrame([(1, "a b " * 400_000), (2, "x" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in lm.score_words(long).collect()} == {1: 800_000, 2: 1}


def test_scores_are_sums_of_the_tokens(spark):
    net = lm.Network()
    weights = net.first()
    ids = np.random.default_rng(0).integers(1, net.tokens, 5000).astype("<u2")
    one = lm.log_probabilities(net, weights, *lm.windows(ids, np.array([0, 5000]), 2))
    two = lm.log_probabilities(net, weights, *lm.windows(np.r_[ids, ids], np.array([0, 5000, 10000]), 2))
    assert np.allclose(one, two[:5000]) and np.allclose(one, two[5000:], atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, quality.learn(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == bool(r.predicted) for r in rows)
    assert sum(r.predicted == r.quality for r in held) > 0.98 * len(held)


def test_features_and_scores_against_plain_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()[:150] + [Row(doc_id=-k, text=t) for k, t in enumerate(["", None, "A b b b.", "ÄÖ 12\n\n!!", "x" * 3000], 1)]
    ranking = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score_quality(docs, ranking).collect()}
    blank, letter = b"\t\n\x0b\x0c\r ", lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    for r in rows:
        raw = (r.text or "").encode()
        n, words = max(1, len(raw)), [w for w in re.split(rb"[\t-\r ]+", raw) if w]
        lowered = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        mark = [not letter(c) and not 48 <= c <= 57 and c not in blank for c in raw]
        m = max(1, len(words))
        lines = raw.count(b"\n") + 1
        dense = [
            sum(65 <= c <= 90 for c in raw) / n, sum(48 <= c <= 57 for c in raw) / n, sum(mark) / n, sum(c in blank for c in raw) / n, np.log1p(n) / 10, n / m / 10, len(set(lowered)) / m, sum(a == b for a, b in zip(lowered, lowered[1:], strict=False)) / m,
            sum(mark[k] and raw[k + 1] in blank for k in range(len(raw) - 1)) / m, sum(mark[k] and raw[k] == raw[k - 1] for k in range(1, len(raw))) / n, sum(65 <= raw[k] <= 90 and letter(raw[k - 1]) for k in range(1, len(raw))) / n, np.log1p(lines) / 10, len(words) / lines / 100 if words else 1 / lines / 100, min(1, 1 / m),
        ]
        x = np.array([np.sqrt(raw.count(bytes([c])) / n) for c in range(256)] + dense)
        strength = sum(float(np.clip((x[k] - ranking.mean[k]) / ranking.spread[k], -8, 8)) * ranking.weights[k] for k in range(len(x)))
        score = 1 / (1 + np.exp(-np.clip((strength - ranking.threshold) / ranking.scale + np.log(0.3 / 0.7), -40, 40)))
        assert abs(got[r.doc_id].score - score) < 1e-4, (r.doc_id, got[r.doc_id].score, score)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as quality", "0.5 as score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None), (77, 1)], "doc_id long, quality int")):
        ranking = quality.learn(docs, labels)
        got = quality.score_quality(docs, ranking).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert quality.keep_good(docs, ranking).columns == docs.columns
        assert quality.score_quality(docs.limit(0), ranking).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = SF
    _, first = corpus_pipeline.STAGES[0]
    good = first(spark, docs, folder).cache()
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, p in scores.items() if p)
    single = corpus_pipeline.STAGES[1][1](spark, good, folder).cache()
    want = brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c, _) in want.items() if c == d)
    mixed = corpus_pipeline.STAGES[2][1](spark, single, folder).cache()
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    # each source's words come near the target that its share of this stage's input gives
    sizes = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in single.collect()}
    by_source = {}
    for s, n in sizes.values():
        by_source[s] = by_source.get(s, 0) + n
    goal = water(by_source, (1.0, 2.0, 3.0), 3.0)
    for s in by_source:
        rate = goal[s] / by_source[s] if by_source[s] else 0
        off = sum(n * n for x, n in sizes.values() if x == s) * (rate % 1) * (1 - rate % 1)
        assert abs(sum(n * copies.get(d, 0) for d, (x, n) in sizes.items() if x == s) - goal[s]) <= 4.5 * off**0.5 + 1
    packed = corpus_pipeline.STAGES[3][1](spark, mixed, folder).collect()
    rows = mixed.select("doc_id", "text").distinct().collect()
    length = {r.doc_id: len(ids) + 1 for r, ids in zip(rows, whole(WORDS, [r.text for r in rows]), strict=True)}
    assert sum(r.length for r in packed) == sum(length[d] * n for d, n in copies.items())
    ids = dict(zip([r.doc_id for r in rows], whole(WORDS, [r.text for r in rows]), strict=True))
    once = mixed.dropDuplicates(["doc_id"])
    check_packing(corpus_pipeline.STAGES[3][1](spark, once, folder).collect(), {d: [*v, 1] for d, v in ids.items()})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_null_ids_repeats_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = docs.limit(20).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(5)).unionByName(docs.limit(5).selectExpr("doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source", "n_chars"))
    every = docs.unionByName(odd)
    for name in ("__gone", "__turn", "__page", "__source", "at", "row", "key", "copies", "score", "size"):
        every = every.selectExpr("*", f"'x' as {name}")
    every.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = read
    for _, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, str(tmp_path))
        assert stage.columns == read.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and len({(r.sequence_id, r.offset) for r in out}) == len(out)
