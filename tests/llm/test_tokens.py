import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing, token_counts

SF = "/root/testdata/sf0.01"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "   ", "a", " a", "a ", "a  b", "a   b", "\n a", "a \n b", "a\n \nb", "a \n", "a  b", "x<|endoftext|>y", "x <|endoftext|> y", "don't I'll we've '' 's", "é é ́ x", "日本 語 123 4567", "tab\tb  ", "a\x1cb \x1d c", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "<|startoftext|>a", "z" * 5000, "   a 　 b", "🙂🙂 🙂"]


def whole(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, length int, salt int")


def test_counts_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: (len(r.text.encode()), len(ids), len(ids) > 1024) for r, ids in zip(rows, whole(BYTES, [r.text for r in rows]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTES).collect()} == want


def test_counts_of_odd_texts(spark):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, ODD), BYTES).collect()}
    assert [got[k] for k in range(len(ODD))] == [len(x) for x in whole(BYTES, ODD)]
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BYTES).collect()), key=str) == [(1, 1, 1), (1, 1, 1), (None, 0, 0)]
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


def check_packing(rows, want, capacity=4096):
    """rows against ids by document (with the end id): pieces whole and in order, sequences gapless from 0."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, own in pieces.items():
        ids = want[doc]
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, k * capacity) for k in range(-(-len(ids) // capacity))]
        for r in own:
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: [*ids, 1] for r, ids in zip(rows, whole(WORDS, [r.text for r in rows]), strict=True)}
    used = check_packing(packing.pack_documents(docs, WORDS).collect(), want)
    assert used <= 1 + -(-sum(map(len, want.values())) // 4096)


def test_packing_of_odd_texts(spark):
    want = {k: [*ids, 1] for k, ids in enumerate(whole(WORDS, ODD))}
    check_packing(packing.pack_documents(frame(spark, ODD), WORDS, capacity=64).collect(), want, 64)
    df = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = packing.pack_documents(df, WORDS).collect()
    assert sorted(r.length for r in got) == [1, 3, 3]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    low = [1, 30, 1, 51, 40, 1][seed]
    for length in draw.integers(low, 101, [50, 300, 1000, 80, 200, 3][seed]):
        counts[length] += int(draw.integers(1, 50))
    slots, sequences = packing.plan(counts, 100)
    taken, used = defaultdict(list), defaultdict(list)
    for length, rank, many, first, offset in slots.tolist():
        taken[length] += range(rank, rank + many)
        for k in range(many):
            used[first + k].append((offset, length))
    assert {k: len(v) for k, v in taken.items()} == {k: int(n) for k, n in enumerate(counts) if n}
    assert all(sorted(v) == list(range(len(v))) for v in taken.values())
    assert sorted(used) == list(range(sequences))
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 100
    if low == 51:
        assert sequences == counts.sum()


def test_exact_complements_leave_no_gap():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 4, 5, 2, 1, 8]] = [3, 3, 2, 2, 2, 2, 2, 1]
    counts[1] += 0
    total = int((np.arange(11) * counts).sum())
    _, sequences = packing.plan(counts, 10)
    assert sequences == -(-total // 10)


def test_pieces_add_up_for_awkward_texts():
    parts = [" ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "a", "Bc", "é", "É", "ß", "'s", "’", "1", "23", "½", "!", "--", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "日本", "́", "İ", "ΑΣ", "🙂", "ª", "\x00", "_", "ﬁ", "Ⅷ"]
    draw = random.Random(5)
    lengths, ids = token_counts._Lengths(BYTES), packing._Ids(WORDS)
    whole = token_counts._tokenizer(BYTES)
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        cut = token_counts.pieces(text)
        assert cut is None or sum(map(lengths.__getitem__, cut)) == len(whole.encode(text, add_special_tokens=False).ids), repr(text)
        assert ids.of(text) == ids.whole(text), repr(text)


def test_pre_tokens_are_those_of_the_pattern():
    import public_tokenizers as public
    import regex

    parts = [" ", " ", "  ", "\n", "\t", "\x85", "\xa0", "a", "Bc", "é", "ß", "'s", "'re", "'T", "'", " '", "1", "23", "½", "!", "--", "Ж", "’", "\u2003", "€"]
    draw, pattern = random.Random(8), regex.compile(public.PATTERN)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(5000)]
    cut = token_counts.Cut(texts, ())
    assert not cut.others
    for k, t in enumerate(texts):
        assert [cut.text(j) for j in range(cut.begin[k], cut.begin[k + 1])] == pattern.findall(t), repr(t)


def test_every_known_character_has_the_librarys_class():
    texts = [f"{chr(c)}a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for lo, hi in token_counts._BLOCKS for c in range(lo, hi)]
    assert token_counts.count_texts(texts, token_counts._lengths(BYTES), token_counts.compact_table(BYTES, [" a", "1"])) == [len(x) for x in whole(BYTES, texts)]


def test_long_texts_are_cut_at_safe_places(spark, monkeypatch):
    long = ["ab cd's  x " * 20_000 + " tail", "日本 x " * 20_000, "z" * 100_000, "a b<|endoftext|> " * 9_000, " " * 50_000, "don't " * 30_000]
    want = [len(x) for x in whole(BYTES, long)]
    monkeypatch.setattr(token_counts, "BLOCK", 5000)
    assert token_counts.count_texts(long, token_counts._lengths(BYTES), token_counts.compact_table(BYTES, [])) == want
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, long), BYTES).collect()}
    assert [got[k] for k in range(len(long))] == want
    check_packing(packing.pack_documents(frame(spark, long), WORDS).collect(), {k: [*ids, 1] for k, ids in enumerate(whole(WORDS, long))})


def test_null_and_repeated_ids_share_no_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 500)
    rows = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'a b c' as text").unionByName(spark.range(5_000).selectExpr("3L as doc_id", "concat('a b ', id % 9) as text"))
    got = packing.pack_documents(rows, WORDS).collect()
    assert len(got) == 15_000 and len({(r.sequence_id, r.offset) for r in got}) == 15_000
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1 + sum(r.length for r in got) // 4096 + 1
