import zlib

from loomgraph.llm import media


def test_resampled_pcm_is_a_column_of_the_result(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(media, "stash", lambda df, label, keep=media.stash: made.setdefault(label, keep(df, label)))
    df = spark.createDataFrame([(1, None), (2, "abc"), (None, "é" * 500), (2, "abc" * 700)], "doc_id long, text string")
    got = media.text_audio(df).collect()
    want = sorted(bytes(r.pcm) for r in media.decode_media(made["media"]).collect())
    assert sorted(bytes(r.pcm) for r in got) == want and min(map(len, want)) == 4 * media.UNIT
    assert all(r.feature.endswith(f";pcm16000={zlib.crc32(bytes(r.pcm)):08x}") for r in got)


def test_downwards_without_what_the_new_rate_cannot_hold():
    import numpy as np

    at = np.arange(8000)
    low, high = (10000 * np.sin(2 * np.pi * f * at / 8000) for f in (200, 3700))
    out = media.resampled((low + high).astype(np.int16), 8000, 4000).astype(float)
    assert np.abs(out - low[::2])[100:-100].max() < 300
    assert media.low_pass(low.astype(np.int16), 8000, 16000).tolist() == low.astype(np.int16).tolist()
