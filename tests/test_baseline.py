from stopdelay.operators import baseline as b


def test_predictions_do_not_fit_again(spark):
    """What is read of predictions, however often, joins the written tables and sums nothing."""
    df = spark.createDataFrame([("S1", "a", 3 * i, 3 * i >= 6) for i in range(5)] + [("S2", "b", 1, False)], "station_name string, train_type string, target_delay_min int, target_delayed6 boolean")
    out = b.predict_baseline(b.fit_baseline(df), df)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.station_name, r.baseline_prob, r.baseline_p50, r.baseline_p90) for r in out.collect()}
    assert got == {("S1", 0.6, 6, 12), ("S2", 0.0, 1, 1)} and out.count() == 6
