from millrace.llm import toxicity


def test_repeated_id_does_not_crowd_out_a_label(spark):
    docs = spark.createDataFrame([(1, f"calm {i}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 30)], "id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 30)], "id long, label int")
    got = toxicity._sample(docs, labels, 8).collect()
    # the ordinary id once, eight toxic ids to train on and two to calibrate with
    assert sorted(r.label for r in got) == [0] + [1] * (8 + 2)
