"""Whole jobs: lake, profile store, streams, model."""

import hashlib
import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from txlake.ml import features, forest
from txlake.ml import model as ml_model
from txlake.ml.model import FraudModel, resolve_weights, train
from txlake.plans.medallion import run_medallion
from txlake.plans.profile_batch import run_profile_batch
from txlake.plans.scoring import analyze
from txlake.plans.serving import ServingView
from txlake.schemas import SCORED_TRANSACTION, USER_PROFILE
from txlake.session import durable, scratch_path, scratch_root
from txlake.sinks.keyed import KeyedTable
from txlake.sinks.lake import lake_readiness
from txlake.sinks.layout import LakeLayout
from txlake.sinks.publish import as_messages, notifications, publish, with_envelope
from txlake.sources import sample
from txlake.sources.events import read_event_log, replay_event_log
from txlake.sources.landing import EmptyLandingError, load_normalized, read_by_format, read_landing_json
from txlake.streaming import ingest, rates
from txlake.streaming.scoring import start_scoring

RECORD = {
    "transaction_id": "t1", "user_id": "u1", "amount": 10.5, "currency": "BRL", "merchant_id": "m1", "merchant_category": "Viagem",
    "timestamp": "2025-03-29T22:15:00", "user_country": "BR", "merchant_country": "US", "payment_method": "PIX", "is_fraud": False}


def write_text(spark, lines):
    path = scratch_path(spark, "text")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_scratch_follows_the_session(spark):
    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master, applicationId="x"))

    assert scratch_root(session("yarn", "hdfs://shared/ckpt/")) == "hdfs://shared/ckpt"
    with pytest.raises(ValueError):
        scratch_root(session("yarn", None))
    assert scratch_root(spark) == scratch_root(spark)


def test_layout():
    layout = LakeLayout("s3a://bucket/lake/")
    assert layout.bronze() == layout.path("raw") == layout.path("landing") == "s3a://bucket/lake/bronze/transactions"
    assert layout.path("processed") == layout.silver() and layout.path("curated") == layout.gold() == "s3a://bucket/lake/gold/transactions_ml"
    with pytest.raises(ValueError):
        layout.path("platinum")


def test_landing_lines_arrays_and_bad_records(spark):
    lines = write_text(spark, [json.dumps(RECORD), '{"transaction_id": 5, "amount": "x"}', "not json"])
    rows = read_landing_json(spark, lines).cache()
    assert rows.count() == 3 and rows.filter("_corrupt_record is not null").count() == 2
    assert str(rows.filter("transaction_id = 't1'").first()["timestamp"]) == "2025-03-29 22:15:00"
    array = write_text(spark, [json.dumps([RECORD, {**RECORD, "transaction_id": "t2", "timestamp": "soon"}])])
    assert {r["transaction_id"]: r["timestamp"] is None for r in read_landing_json(spark, array, array=True).collect()} == {"t1": False, "t2": True}
    assert tuple(load_normalized(spark, array).orderBy("hour").collect()[1]) == (10.5, "Viagem", "PIX", 22, 1, 1)
    with pytest.raises(EmptyLandingError):
        read_landing_json(spark, write_text(spark, ["[]"]), array=True)
    with pytest.raises(ValueError):
        read_by_format(spark, lines, "xml")


def test_medallion_runs_again_over_itself(spark, small):
    layout = LakeLayout(scratch_path(spark, "lake"))
    assert [r["ready"] for r in lake_readiness(spark, layout).collect()] == [False] * 3
    tx = sample.transactions(spark, small).filter("timestamp < timestamp_ntz'1995-03-01'")
    counts = [{k: v.count() for k, v in run_medallion(spark, tx, layout).items()} for _ in range(2)]
    assert counts[0] == counts[1] and counts[0]["silver"] == tx.select("transaction_id").distinct().count() == counts[0]["gold"]
    assert [r["ready"] for r in lake_readiness(spark, layout).collect()] == [True] * 3
    assert spark.read.json(layout.reports("dq_history")).count() == 2 and spark.read.json(layout.reports("dq_latest")).count() == 1


def test_profile_store_is_replaced_by_user(spark, small):
    tx = sample.transactions(spark, small)
    store = KeyedTable(spark, scratch_path(spark, "store"), USER_PROFILE, "user_id")
    runs = scratch_path(spark, "runs")
    assert store.read().isEmpty()
    everyone = run_profile_batch(tx, store, runs).count()
    one = tx.filter("user_id = 'user_1'")
    after = run_profile_batch(one, store, runs)
    assert after.count() == everyone == after.select("user_id").distinct().count()
    assert after.filter("user_id = 'user_1'").first()["tx_count"] == one.count()
    assert sorted(r["profiles_written"] for r in spark.read.parquet(runs).collect()) == [1, everyone]


def test_scored_rows_have_the_agreed_fields(spark, small):
    none = spark.createDataFrame([], USER_PROFILE)
    rows = analyze(sample.transactions(spark, small), none, F.col("timestamp"))
    assert rows.columns == SCORED_TRANSACTION.fieldNames() and rows.filter("profile_found").isEmpty()
    text = notifications(rows).filter("body not like '%Titular: %*%'")
    assert text.isEmpty(), "holders are masked in notifications"


def log_of(spark, records):
    frame = spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in records], "value string")
    path = scratch_path(spark, "log")
    publish(frame, location=path)
    return path


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_restarts_and_drops_repeats(spark):
    first = {**RECORD, "event_id": "e1"}
    path = log_of(spark, [first, first, "{broken", {"user_id": "u"}, {**RECORD, "transaction_id": "t2", "timestamp": "soon"}])
    out, dead, ckpt, dckpt = (scratch_path(spark, n) for n in ("out", "dead", "ckpt", "dckpt"))

    def run():
        drain(ingest.start_unique(ingest.good_events(read_event_log(spark, path)), out, ckpt))
        drain(ingest.start(ingest.dead_letters(read_event_log(spark, path)), dead, dckpt))
        return sorted(r[0] for r in spark.read.parquet(out).select("transaction_id").collect())

    assert run() == ["t1"]
    assert sorted(r["reason"] for r in spark.read.parquet(dead).collect()) == ["malformed", "no_event_time", "no_transaction_id"]
    assert run() == ["t1"], "a restart reads nothing twice"
    publish(spark.createDataFrame([(json.dumps(first),), (json.dumps({**RECORD, "transaction_id": "t3"}),)], "value string"), location=path)
    assert run() == ["t1", "t3"], "the repeat is known from what is stored"
    assert replay_event_log(spark, path).count() == 7


def test_late_events_in_several_batches_are_kept_once(spark):
    times = ["2024-01-01T10:00:00", "2024-01-01T12:30:00", "2024-01-01T09:00:00", "2023-05-01T00:00:00"]
    path = None
    base, out = scratch_path(spark, "online"), scratch_path(spark, "out")
    profile = spark.createDataFrame([], "user_id string, tx_count long, avg_amount double, std_amount double, p95_amount double, avg_hour double, "
                                    "typical_categories array<string>, typical_payment_methods array<string>")
    ckpts = [scratch_path(spark, "ckpt") for _ in range(4)]
    for n, time in enumerate(times):
        records = [{**RECORD, "transaction_id": f"t{n}", "timestamp": time}, {**RECORD, "transaction_id": "t0", "timestamp": times[0]}]
        frame = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
        path = path or scratch_path(spark, "log")
        publish(frame, location=path)
        drain(ingest.start_unique(ingest.good_events(read_event_log(spark, path)), out, ckpts[0]))
        drain(start_scoring(ingest.good_events(read_event_log(spark, path)), profile, base, ckpts[1]))
    for kind, ckpt in (("events", ckpts[2]), ("scores", ckpts[3])):  # from the start again
        if kind == "events":
            drain(ingest.start_unique(ingest.good_events(read_event_log(spark, path)), out, ckpt))
        else:
            drain(start_scoring(ingest.good_events(read_event_log(spark, path)), profile, base, ckpt))
    for folder in (out, f"{base}/history"):
        assert sorted(r[0] for r in spark.read.parquet(folder).select("transaction_id").collect()) == ["t0", "t1", "t2", "t3"]


def test_online_scores_equal_batch_scores(spark):
    records = [{**RECORD, "transaction_id": f"t{i}", "user_id": f"u{i % 3}", "amount": 100.0 * i, "payment_method": "CREDIT_CARD"} for i in range(60)]
    path = log_of(spark, records)
    profile = spark.createDataFrame([("u1", 9, 50.0, 5.0, 80.0, 12.0, ["Viagem"], ["PIX"])], "user_id string, tx_count long, avg_amount double, "
                                    "std_amount double, p95_amount double, avg_hour double, typical_categories array<string>, typical_payment_methods array<string>")
    base, ckpt = scratch_path(spark, "online"), scratch_path(spark, "ckpt")
    for _ in range(2):
        drain(start_scoring(ingest.good_events(read_event_log(spark, path)), profile, base, ckpt))
    online = spark.read.parquet(f"{base}/history")
    batch = analyze(ingest.decoded(replay_event_log(spark, path)), profile, F.col("event_time"))
    fields = ["transaction_id", "fraud_score", "risk_level", "anomaly_reasons", "profile_found", "amount"]
    assert sorted(map(str, online.select(*fields).collect())) == sorted(map(str, batch.select(*fields).collect()))
    frauds = batch.filter("is_fraud").count()
    assert 0 < frauds == spark.read.parquet(f"{base}/alerts").count() == spark.read.parquet(f"{base}/notifications").count()


def test_envelopes(spark):
    message = as_messages(with_envelope(spark.createDataFrame([(1, "u")], "amount int, user_id string"))).first()
    fields = json.loads(message["value"])
    assert message["key"] == "u" and len(fields["event_id"]) == 36 and fields["event_timestamp"]


def test_streamed_rates_equal_batch_rates_on_closed_windows(spark, small):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    log = sample.table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    log.write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 minute")
    for frame, batch in (
        (rates.request_rates(stream, "ts"), rates.request_rates(log, "ts")),
        (rates.latency_quantile(stream, "ts", "value"), rates.latency_quantile(log, "ts", "value")),
    ):
        out = scratch_path(spark, "rates")
        drain(ingest.start(frame, out, scratch_path(spark, "ckpt")))
        closed = spark.read.parquet(out)
        assert closed.count() > 100
        assert closed.exceptAll(batch).isEmpty(), "what the stream closed is what the batch finds"


def test_quantile_inside_a_bucket(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 101)], "value double").withColumn("ts", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    got = rates.latency_quantile(rows, "ts", "value", bounds=(50.0, 90.0, 100.0)).collect()
    assert len(got) == 5 and {r["quantile"] for r in got} == {95.0}
    beyond = rates.latency_quantile(rows, "ts", "value", bounds=(10.0, 20.0)).first()
    assert beyond["quantile"] is None, "the buckets do not reach it"


@pytest.fixture(scope="module")
def labelled(spark, small):
    rows = features.training_rows(sample.transactions(spark, small).dropna(subset=["amount"]).dropDuplicates(["transaction_id"]))
    label = (F.col("amount") > 50000) & (F.col("is_international") == 1)
    frame = rows.select("transaction_id", "amount", "hour", "is_weekend", "is_international", "merchant_category", "payment_method", label.cast("int").alias("label"))
    path = scratch_path(spark, "labelled")
    frame.withColumn("amount", F.greatest("amount", F.lit(0.0))).write.parquet(path)
    return spark.read.parquet(path)


def test_split_keeps_shares_and_rows(labelled):
    fit_part, test_part = features.stratified_split(labelled, "label")
    n = dict(labelled.groupBy("label").count().collect())
    assert dict(fit_part.groupBy("label").count().collect()) == {k: int(v * 0.8 + 0.5) for k, v in n.items()}
    assert fit_part.join(test_part, "transaction_id").isEmpty() and fit_part.count() + test_part.count() == labelled.count()


def test_unseen_labels_and_constant_features(spark, labelled):
    state = features.fit_features(labelled.withColumn("is_weekend", F.lit(1)))
    assert state.scales["is_weekend"] == 1.0
    odd = labelled.limit(1).withColumn("merchant_category", F.lit("never seen"))
    assert state.encode(odd).first()["merchant_category_encoded"] == -1


def test_forest_scores_match_a_walk_through_its_nodes(spark, labelled):
    state = features.fit_features(labelled)
    # Many odd rows: a single one would be in the samples of few trees only.
    odd = labelled.limit(60).withColumns({
        "amount": F.lit(1e6) + F.col("amount") * 50, "hour": F.lit(90), "transaction_id": F.concat(F.lit("odd-"), "transaction_id")})
    scaled = state.transform(labelled.unionByName(odd))
    path = scratch_path(spark, "forest")
    forest.fit_forest(scaled, trees=40).write.parquet(path)
    trees = spark.read.parquet(path)
    assert trees.select("tree").distinct().count() == 40 and {r[0] for r in trees.select("points").distinct().collect()} == {256}
    scored = scaled.select("transaction_id", "features", forest.anomaly_score(trees).alias("a")).cache()
    assert scored.filter("a <= 0 or a > 1").isEmpty()

    nodes = {(r["tree"], r["node"]): r for r in trees.collect()}

    def walk(tree, point):
        node = nodes[tree, 0]
        while node["feature"] >= 0:
            node = nodes[tree, node["left"] if point[node["feature"]] <= node["threshold"] else node["right"]]
        return node["path"]

    for row in scored.orderBy("transaction_id").limit(25).collect():
        mean = sum(walk(t, row["features"]) for t in range(40)) / 40
        assert abs(row["a"] - 2 ** (-mean / forest.usual_path(256))) < 1e-12
    is_odd = F.col("transaction_id").startswith("odd-")
    means = scored.agg(F.avg(F.when(is_odd, F.col("a"))).alias("odd"), F.avg(F.when(~is_odd, F.col("a"))).alias("rest")).first()
    assert means["odd"] > means["rest"] + 0.05


def test_tree_samples_reach_all_rows(spark, labelled):
    """Where rows are few a tree takes from all of them; where they are many, from any of them, beyond a pool of fixed size."""
    few = features.fit_features(labelled).transform(labelled.limit(100))
    samples = forest.tree_samples(few, "transaction_id", trees=10)
    assert {r["count"] for r in samples.groupBy("tree").count().collect()} == {100}
    grown = forest.fit_forest(few, trees=3)
    assert {r[0] for r in grown.select("points").distinct().collect()} == {100} and grown.agg(F.max("path")).first()[0] <= 7 + forest.usual_path(100)
    many = spark.range(20000).select(F.col("id").alias("transaction_id"), F.array(F.col("id").cast("double")).alias("a")).select(
        "transaction_id", array_to_vector("a").alias("features"))
    drawn = forest.tree_samples(many, "transaction_id", trees=5, subsample=20).select("tree", F.col("v")[0].cast("long").alias("id"))
    ids = {r["id"] for r in drawn.collect()}
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {20} and len(ids) == 100
    pool = many.orderBy(F.xxhash64(F.lit(42), "transaction_id")).limit(100).collect()
    assert ids - {r["transaction_id"] for r in pool}, "no pool of the smallest hashes"


def test_boosting_rounds_read_points_not_rows(spark, labelled, monkeypatch):
    """Every row thirty times, as rows of their own: the rounds see no more points, and the points stand for all rows."""
    seen, fit = [], ml_model.GBTClassifier.fit
    monkeypatch.setattr(ml_model.GBTClassifier, "fit", lambda self, points: seen.append(points) or fit(self, points))
    rows = labelled.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("copy")).withColumn(
        "transaction_id", F.concat_ws("-", "transaction_id", "copy")).drop("copy")
    model = train(rows, rounds=2, depth=3)
    assert seen[0].count() <= labelled.count() and seen[0].agg(F.sum("copies")).first()[0] == round(rows.count() * 0.8)
    # a tree over points tells rows apart exactly as one over the rows themselves
    scaled = model.features.transform(labelled)
    points = ml_model.training_points(scaled, "label")
    trees = [fit(ml_model.GBTClassifier(labelCol="label", featuresCol="bins", weightCol=w, maxIter=3, maxDepth=3, seed=1), part)
             for part, w in ((points, "copies"), (scaled.withColumn("one", F.lit(1.0)), "one"))]
    values = [{r["transaction_id"]: round(r["probability"][1], 9) for r in t.transform(scaled).select("transaction_id", "probability").collect()} for t in trees]
    assert values[0] == values[1]


def test_the_parts_of_a_split_do_not_rank_all_rows_again(spark, labelled):
    for part in features.stratified_split(labelled, "label"):
        assert "Window" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_boosted_trees_are_walked_once_per_vector_of_bins(spark):
    walked = []

    class Trees:
        def transform(self, rows):
            walked.append(rows.count())
            sums = F.aggregate(vector_to_array("bins"), F.lit(0.0), lambda a, b: a + b)
            return rows.withColumn("probability", array_to_vector(F.array(1 - sums, sums)))

    vectors = [[0.0] * 6 + [float(n % 3)] for n in range(30)] + [[33.0] + [0.0] * 6] * 5
    binned = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>").select("id", array_to_vector("v").alias("bins"))
    got = FraudModel(None, Trees(), None).with_probability(binned)
    assert {r.id: r.probability for r in got.collect()} == {n: sum(v) for n, v in enumerate(vectors)}
    assert got.count() == 35 and set(walked) == {4}


def test_edges_part_few_values_each_and_many_by_quantiles(spark, labelled):
    scaled = features.fit_features(labelled).transform(labelled)
    edges = features.learn_edges(scaled)
    hours = sorted(r[0] for r in scaled.select("hour_scaled").distinct().collect())
    assert len(edges["hour"]) == len(hours) - 1 and all(a < e < b for a, e, b in zip(hours, edges["hour"], hours[1:]))
    assert 20 < len(edges["amount"]) < features.BINS


def test_model_round_trip(spark, labelled):
    model = train(labelled, rounds=5, depth=4)
    assert model.metrics["auc_roc"] > 0.9 and model.metrics["recall"] > 0.8
    importance = model.importance(spark)
    assert abs(importance.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = FraudModel.load(spark, path)
    assert again.metrics == model.metrics
    one, two = (m.predict(labelled).select("transaction_id", "fraud_score", "risk_level") for m in (model, again))
    assert one.exceptAll(two).isEmpty()
    # alone, every row is the strangest of its batch
    row = model.ensemble(labelled, "row")
    assert row.filter("abs(model_score - least(1.0, 0.4 + 0.6 * probability)) > 1e-9").isEmpty()
    fixed = resolve_weights(spark, None).collect()
    assert fixed[0]["feature"] == "amount" and fixed[0]["percent"] == 28.0 and len(fixed) == 7


def batches_of(spark, count, repeat_from=2):
    """A log that grows by one file per micro-batch: one new transaction, one repeat of the first."""
    path = scratch_path(spark, "log")
    for n in range(count):
        records = [{**RECORD, "transaction_id": f"t{n}"}] + [{**RECORD, "transaction_id": "t0"}] * (n >= repeat_from)
        spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(1).write.mode("append").text(path)
    return path


def test_no_batch_reads_the_history(spark, monkeypatch):
    """Other runs' ids are read when a query starts; batch 50 takes in what batch 2 does."""
    reads = []
    read = ingest.stored_by_others
    monkeypatch.setattr(ingest, "stored_by_others", lambda *a: (reads.append(a), read(*a))[1])
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        path, out = batches_of(spark, 51), scratch_path(spark, "out")
        stored = spark.createDataFrame([("t0",), ("t7",), ("old",)], "transaction_id string")
        stored.write.parquet(ingest.batch_folder(out, "another", 0))
        events = ingest.good_events(read_event_log(spark, path, maxFilesPerTrigger="1"))
        query = ingest.start_unique(events, out, scratch_path(spark, "ckpt"))
        drain(query)
        progress = {p["batchId"]: p for p in query.recentProgress if p["numInputRows"]}
        assert len(progress) == 51 and len(reads) == 2, "at the start and with the first micro-batch"
        rows = {n: sorted(s["numInputRows"] for s in p["sources"]) for n, p in progress.items()}
        assert rows[0] == [1, 3] and rows[50] == rows[2] == [0, 2]
        operator = progress[50]["stateOperators"][0]
        assert operator["numRowsTotal"] == 52 and "rocksdbGetCount" in operator["customMetrics"]
        assert operator["customMetrics"]["rocksdbGetCount"] <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    ids = [r[0] for r in spark.read.parquet(out).select("transaction_id").collect()]
    assert sorted(ids) == sorted([*(f"t{n}" for n in range(51)), "old"]), "each once, those of the other run included"


def test_run_folders_that_look_like_numbers(spark):
    """Checkpoints whose hash reads as a number in exponent form, or as digits behind a zero; a retried batch writes the same."""
    leading = next(n for n in range(10**6) if (h := hashlib.md5(f"/ckpt/{n}".encode()).hexdigest()[:12]).isdigit() and h[0] == "0")
    for name in ("/ckpt/148", f"/ckpt/{leading}"):
        path, out = batches_of(spark, 2, 0), scratch_path(spark, "out")
        checkpoint = scratch_path(spark, "ckpt")
        written = []

        def write(rows, batch_id):
            if len(written) == 1:
                written.append(None)
                raise RuntimeError("a lost executor")
            rows.write.mode("overwrite").parquet(ingest.batch_folder(out, name, batch_id))
            written.append(batch_id)

        events = ingest.good_events(read_event_log(spark, path, maxFilesPerTrigger="1"))
        with pytest.raises(Exception):
            ingest.start_keyed(events, out, checkpoint, write).awaitTermination()
        drain(ingest.start_keyed(events, out, checkpoint, write))
        drain(ingest.start_keyed(events, out, checkpoint, write))
        assert {r["run"] for r in spark.read.parquet(out).select("run").collect()} == {ingest.run_name(name)}
        assert sorted(r[0] for r in spark.read.parquet(out).select("transaction_id").collect()) == ["t0", "t1"]


def test_serving_view_between_batches(spark):
    """No gap, no overlap: refreshed in the middle, with a micro-batch that isn't whole, and by two jobs at once."""
    out = scratch_path(spark, "out")
    view = ServingView(spark, out, scratch_path(spark, "serving"))
    assert view.read().collect() == []

    def store(run, number, ids):
        rows = spark.createDataFrame([(i, f"u{int(i) % 2}", float(i)) for i in ids], "transaction_id string, user_id string, amount double")
        rows.withColumn("event_time", F.timestamp_seconds(F.col("amount"))).write.parquet(ingest.batch_folder(out, run, number))

    def served():
        return {r.user_id: (r.tx_count, int(r.amount_sum)) for r in view.read().collect()}

    store("a", 0, "12")
    assert served() == {"u0": (1, 2), "u1": (1, 1)} and view.refresh() and served() == {"u0": (1, 2), "u1": (1, 1)}
    store("a", 1, "3")
    store("b", 0, "4")
    assert served() == {"u0": (2, 6), "u1": (2, 4)}
    offsets = view.offsets()
    other = ServingView(spark, out, view.base)
    other.offsets = lambda: offsets  # it looked before the next refresh
    assert view.refresh() and not other.refresh(), "one view per number"
    spark.createDataFrame([("9", "u1", 9.0)], "transaction_id string, user_id string, amount double").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(ingest.batch_folder(out, "b", 1))
    store("a", 2, "56")
    assert served() == {"u0": (3, 12), "u1": (3, 9)} and view.refresh() and served() == {"u0": (3, 12), "u1": (3, 9)}
    assert sorted(view.offsets()[1].values()) == [0, 2]


def test_profile_state_adds_up(spark, small):
    """Three days into the state, one of them twice, equal the profiles of all rows; odd amounts included."""
    from txlake.operators.profiles import build_profiles, profile_rows
    from txlake.plans.profile_state import ProfileState

    tx = sample.transactions(spark, small).withColumn("amount", F.when(F.crc32(F.col("transaction_id").cast("binary")) % 50 == 0, F.col("amount") / 3).otherwise(F.col("amount")))
    rows = profile_rows(tx.withColumn("user_id", F.when(F.col("user_id").endswith("1"), "hot").otherwise(F.col("user_id"))))
    state = ProfileState(spark, scratch_path(spark, "state"), 4)
    day = F.pmod(F.xxhash64("amount", "hour"), F.lit(3))
    for n in (0, 1, 1, 2):
        state.add(rows.where(day == n), f"day-{n}")
    wanted, got = (sorted(map(str, p.drop("updated_at").collect())) for p in (build_profiles(rows), state.profiles()))
    assert got == wanted


def test_oltp_scan_cleans_what_the_reader_gives(spark, tmp_path, monkeypatch):
    from txlake.catalog import lake

    rows = sample.transactions(spark, "/root/testdata/sf0.001").limit(1).withColumn("transaction_id", F.lit("a")).drop("amount")
    amounts = spark.createDataFrame([(None,), (5.0,), (-7.25,)], "amount double")
    dirty = rows.crossJoin(amounts).unionByName(rows.crossJoin(amounts.filter("amount < 0")).withColumn("transaction_id", F.lit("b")))
    monkeypatch.setattr(lake.sample, "transactions", lambda s, f: dirty)
    got = lake.oltp_scan(spark, str(tmp_path)).select("transaction_id", "amount").collect()
    assert sorted(map(tuple, got)) == [("a", "5.00"), ("b", "0.00")]


def test_ordered_log_is_not_one_file(spark, tmp_path):
    """Afternoons come in older files than mornings, each part in a file per task."""
    from txlake.catalog import flows

    log = str(tmp_path / "log")
    lines = [f'{{"transaction_id": "t{n}", "timestamp": "2024-01-01T{n % 24:02d}:00:00.000000"}}' for n in range(480)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(4).write.text(log)
    ordered, files = flows._afternoons_first(spark, log)
    ages = sorted((Path(f.removeprefix("file://")).stat().st_mtime_ns, f) for f in spark.read.text(ordered).inputFiles())
    assert files > 1 and len(ages) == 2 * files
    hour = F.get_json_object("value", "$.timestamp").substr(12, 2).cast("int")
    older = spark.read.text([f for _, f in ages[:files]]).select(hour.alias("h"))
    assert older.count() == 240 and older.agg(F.min("h")).first()[0] == 12
    assert sorted(r[0] for r in spark.read.text(ordered).collect()) == sorted(lines)


def test_profiles_and_scores_join_the_source_once(spark, tmp_path, small, monkeypatch):
    from txlake.catalog import registry

    folder, joins, whole = str(tmp_path), [], sample.transactions
    monkeypatch.setattr(registry.sample, "transactions", lambda s, f: joins.append(f) or whole(s, small))
    rows = registry.scored(spark, folder)
    assert len(joins) == 1 and rows.count() == whole(spark, small).count()


def tables_made(spark, folder, name, monkeypatch):
    """The keyed tables that a query makes, and what it stores on the way to them."""
    from txlake.catalog import lake
    from txlake.plans import profile_state
    from txlake.sinks import keyed

    made, staged, whole = [], [], keyed.durable

    def noted(*args):
        made.append(KeyedTable(*args))
        return made[-1]

    monkeypatch.setattr(keyed, "durable", lambda df, label: staged.append(label) or whole(df, label))
    monkeypatch.setattr(lake, "KeyedTable", noted)
    monkeypatch.setattr(profile_state, "KeyedTable", noted)
    getattr(lake, name)(spark, folder)
    return made, staged


def test_store_history_writes_new_documents_only(spark, small, monkeypatch):
    """Early and late documents are written once, without being stored on the way; those that come again write nothing."""
    (store,), staged = tables_made(spark, small, "store_history", monkeypatch)
    assert len(store.folder.names("data")) == 2 and not staged
    ids = store.read().select("transaction_id")
    assert ids.count() == ids.distinct().count() == sample.transactions(spark, small).select("transaction_id").distinct().count()


def test_profile_state_of_hot_users_and_known_batches(spark, small, monkeypatch):
    """Users of many rows are counted apart; a batch that comes again, or that another writer has just stored, writes nothing."""
    from txlake.operators import ranking
    from txlake.operators.profiles import build_profiles, profile_rows
    from txlake.plans.profile_state import STATE, ProfileState

    tx = profile_rows(sample.transactions(spark, small))
    rows = durable(tx.withColumn("user_id", F.when(F.col("user_id").endswith("1"), "hot").otherwise(F.col("user_id"))), "rows")
    wanted = sorted(map(str, build_profiles(rows).drop("updated_at").collect()))
    monkeypatch.setattr(ranking, "ORDERED_AT_ONCE", 60)
    state, day = ProfileState(spark, scratch_path(spark, "state"), 4), F.pmod(F.xxhash64("amount", "hour"), F.lit(2))
    for n in (0, 1):
        state.add(rows.where(day == n), f"day-{n}")
    seen, files = state.store.files()[0], state.store.folder.names("data")
    state.add(rows.where(day == 1), "day-1")
    monkeypatch.setattr(KeyedTable, "of_key", lambda self, key: spark.createDataFrame([], STATE))  # it looked before the other's commit
    state.add(rows.where(day == 1), "day-1")
    assert state.store.files()[0] == seen and state.store.folder.names("data") == files
    assert sorted(map(str, state.profiles().drop("updated_at").collect())) == wanted
    facts = state.store.read()
    assert facts.count() == facts.drop("n").distinct().count()


def test_profile_state_stores_each_batch_once(spark, small, monkeypatch):
    (store,), staged = tables_made(spark, small, "profile_state", monkeypatch)
    assert len(store.folder.names("data")) == len(staged) == 2
