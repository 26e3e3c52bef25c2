from loomgraph.llm import near_dedup as nd

LONG = " ".join(f"w{k}" for k in range(60))


def test_only_copies_go_whatever_their_ids(spark):
    rows = [
        (1, LONG), (2, LONG + " end"), (2, "quite another text of its own"), (3, "one text here and more"), (3, "some different words in this row"),
        (None, "no id but a copy"), (None, "no id but a copy"), (4, ""), (4, ""), (5, None), (None, ""), (None, " "), (None, LONG), (None, LONG),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, LONG), *rows[2:6], (4, ""), (5, None), (None, ""), (None, " "), (None, LONG)]
    for parts in (1, 5):
        got = nd.keep_one(df.repartition(parts), 3, 85).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
