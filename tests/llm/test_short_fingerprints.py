import random

import pytest

from loomgraph.llm import fingerprints as fp

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("least", "most", "mean"), [(50, 100, 0.5), (100, 200, 0.55), (200, 413, 0.55), (413, 700, 0.55), (700, 1500, 0.6), (1500, 4096, 0.6), (4096, 6000, 0.6), (6000, 40_000, 0.65)])
def test_edited_copies_stay_near_at_every_length(spark, least, most, mean):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "octet_length(text) as n").where(f"n >= {least} and n < {most}")
    got = fp.fingerprint_neighbours(spark.read.parquet(f"{SF}/documents.parquet")).join(docs, "doc_id").collect()
    assert min(r.near_edited for r in got) > 0 and sum(r.near_edited for r in got) / len(got) > mean


def test_short_texts_are_cut_by_place_and_content():
    draw = random.Random(5)
    raw = bytes(draw.randrange(97, 123) for _ in range(fp.SHORT + 1))
    for n in (0, 1, 8, 9, 63, 64, 65, 300, 1024, 3000):
        ends = fp.cuts(raw[:n])
        assert (ends[-1] if ends else 0) == n and ends == sorted(set(ends))
        kept = [e for e in fp.cuts(raw[:n] + b"another end" * 30) if e < n]
        assert kept[: len(ends) - 1] == ends[:-1]
    assert len(fp.cuts(raw[:150])) > 3
    a, b = raw[: fp.SHORT - 1], raw
    assert fp.containment(fp.chunk_digests(a), fp.chunk_digests(b)) > 0.9
