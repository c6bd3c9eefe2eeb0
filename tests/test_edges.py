"""Hand-made edge rows for decoding, rules, devices, names and URLs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import detections, names, text, times, urls
from shutterlake.operators import alerts, changes, decode, devices, gallery, labeling, ranking, rollups, rules

NOW = "2024-02-01 00:00:00"


def one(spark, column, **values):
    fields = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*fields).select(column.alias("out")).first().out


def test_malformed_messages_do_not_fail_the_job(spark):
    values = [
        '{"device_id":"d","timestamp":"2024-01-01T00:00:00.123Z","image_url":"http://x/a.jpg","image_size":5}',
        '{"device_id":"d","timestamp":"yesterday"}', '{"device_id":null,"timestamp":"2024-01-01T00:00:00Z"}',
        "not json", "", '{"device_id":"d","timestamp":"2024-01-01T00:00:00Z","image_size":"many"}',
    ]
    messages = spark.createDataFrame([(v,) for v in values], "value string")
    parsed = decode.parse_raw(messages)
    assert decode.valid(parsed).count() == 2
    reasons = {r.value: r.reason for r in decode.rejects(parsed).collect()}
    assert reasons == {
        values[1]: "bad_timestamp", values[2]: "missing_device", "not json": "malformed_json", "": "malformed_json",
    }
    rows = decode.normalise_raw(parsed, NOW).collect()
    assert len(rows) == 1 and rows[0].timestamp == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert (rows[0].mime_type, rows[0].image_md5, rows[0].received_at) == ("image/jpeg", "", dt.datetime(2024, 2, 1))


def test_envelope_columns_are_kept(spark):
    row = spark.createDataFrame([(bytearray(b"{}"), dt.datetime(2024, 1, 1), 2, 7)], "value binary, timestamp timestamp, partition int, offset long")
    out = decode.parse_raw(row).first()
    assert (out.kafka_timestamp, out.partition, out.offset) == (dt.datetime(2024, 1, 1), 2, 7)


@pytest.mark.parametrize("raw, expected", [
    ("20240101123000", dt.datetime(2024, 1, 1, 12, 30)), ("99999999999999", None),
    ("1704067200", dt.datetime(2024, 1, 1)), ("1704067200500", dt.datetime(2024, 1, 1, 0, 0, 0, 500000)),
    ("12", dt.datetime(2024, 2, 1)), ("soon", dt.datetime(2024, 2, 1)), ("-1e300", dt.datetime(2024, 2, 1)),
    ("1e300", None), ("Infinity", None), ("NaN", None), ("253402300800000", None), ("999999999999999999", None), (None, dt.datetime(2024, 2, 1)),
])
def test_device_timestamps(spark, raw, expected):
    assert one(spark, times.device_timestamp(F.col("x"), NOW), x=raw) == expected


@pytest.mark.parametrize("size, label", [
    (0, "0 Bytes"), (512, "512 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024**2 + 11000, "5.01 MB"), (3 * 1024**4, "3072 GB"),
])
def test_human_sizes(spark, size, label):
    assert one(spark, text.human_size(F.col("x")), x=size) == label


def test_tolerant_json(spark):
    cases = {'{"a":1}': {"a": "1"}, "hello": {"raw": "hello"}, "": {}}
    for raw, expected in cases.items():
        assert one(spark, text.tolerant_json(F.col("x")), x=raw) == expected


def test_detection_fallbacks(spark):
    raw = '[{"name":"fox","conf":0.7},{"class":"","confidence":0},{"class":"Owl","confidence":0.9}]'
    d = detections.parse(F.col("x"))
    assert one(spark, F.transform(d, detections.species_of), x=raw) == ["fox", "unknown", "Owl"]
    assert one(spark, F.transform(d, detections.confidence_of), x=raw) == [0.7, 0.0, 0.9]
    assert one(spark, detections.class_list(d), x=raw) == "Owl"
    for broken in ("[{", "{}x", "", "null"):
        assert one(spark, F.size(detections.parse(F.col("x"))), x=broken) == 0


def test_file_names(spark):
    row = one(spark, names.name_parts(F.col("x")), x="20240102_030405_cam-1.jpg")
    assert (row.device_id, row.taken_at) == ("cam-1", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert one(spark, names.name_parts(F.col("x")), x="2024_030405_cam.jpg") is None
    assert [one(spark, names.extension(F.col("x")), x=n) for n in ("a.JPG", "noext", ".hidden", "a.tar.gz")] == [".jpg", "", "", ".gz"]


def test_urls(spark):
    key = one(spark, urls.object_key(F.col("x")), x="raw/a.jpg")
    assert key == "raw/a.jpg"
    assert one(spark, urls.key_after_bucket(F.col("x")), x="http://h/other/a.jpg") is None
    assert one(spark, urls.to_public(F.col("x")), x="https://elsewhere/a.jpg?q=1") == "https://elsewhere/a.jpg?q=1"
    assert one(spark, urls.signable_key(F.col("x")), x="http://other/iot-raw/a.jpg") is None
    assert one(spark, text.client_address(F.col("x"), F.col("y")), x="", y="1.2.3.4") == "1.2.3.4"


def event(spark, count, found, device="cam-1"):
    body = ",".join(f'{{"class":"{c}","confidence":{p}}}' for c, p in found)
    return spark.createDataFrame(
        [(device, dt.datetime(2024, 1, 1), "s", "u", count, f"[{body}]")],
        "device_id string, timestamp timestamp, shot_id string, image_url string, detection_count int, detections string",
    )


def rule(spark, *rows):
    names_ = "rule_id string, name string, enabled boolean, conditions string, severity string, cooldown_s int"
    return rules.from_documents(spark.createDataFrame(
        [(f"r{i}", f"n{i}", True, c, "info", 0) for i, c in enumerate(rows)], names_
    ))


@pytest.mark.parametrize("condition, count, found, fires", [
    ('{"type":"detection_count","operator":">=","value":3}', 3, [], True),
    ('{"type":"detection_count","operator":">=","value":3}', 2, [], False),
    ('{"type":"detection_count","operator":"~","value":3}', 5, [], False),
    ('{"type":"confidence","operator":">","value":0.8}', 1, [("a", 0.85)], True),
    ('{"type":"confidence","operator":"<","value":0.8}', 0, [], False),
    ('{"type":"species","operator":"in","value":"BIRD"}', 1, [("bird", 0.5)], True),
    ('{"type":"species","operator":"in","value":["cat","dog"]}', 1, [("Dog", 0.5)], True),
    ('{"type":"species","operator":"==","value":"x","species":["owl"]}', 1, [("owl", 0.5)], True),
    ('{"type":"species","operator":"not_in","value":"bird"}', 1, [("cat", 0.5)], True),
    ('{"type":"species","operator":"not_in","value":"bird"}', 0, [], False),
    ('{"type":"detection_count","operator":">","value":0,"deviceId":"cam-1"}', 1, [("a", 0.1)], True),
    ('{"type":"detection_count","operator":">","value":0,"deviceId":"cam-2"}', 1, [("a", 0.1)], False),
    ('{"type":"weather","operator":">","value":0}', 1, [("a", 0.1)], False),
])
def test_rule_conditions(spark, condition, count, found, fires):
    hits = rules.candidates(event(spark, count, found), rule(spark, condition))
    assert hits.count() == (1 if fires else 0)


def test_rule_defaults_and_messages(spark):
    rows = rule(
        spark, '{"type":"detection_count","operator":">=","value":2}', '{"type":"confidence","operator":">","value":0.5}',
        '{"type":"species","operator":"in","value":"ant"}',
    )
    assert {r.cooldown_s for r in rows.collect()} == {300}
    made = rules.candidates(event(spark, 2, [("ant", 0.876), ("Bee", 0.1)]), rows)
    assert {r.m for r in made.select(rules.message().alias("m")).collect()} == {
        "Alert: 2 objects detected (threshold: >= 2)", "Alert: High confidence detection (87.6%, threshold: > 0.5)",
        "Alert: Species detected: ant, Bee",
    }
    assert rules.invalid(rows.withColumn("severity", F.lit("loud"))).count() == 3


def test_thousands_of_rules_in_one_join(spark):
    """However many rules there are, the events are read once and the plan stays the same."""
    shared = ['{"type":"detection_count","operator":">","value":%d}' % (k % 7) for k in range(2000)]
    sure = ['{"type":"confidence","operator":"%s","value":%s}' % (("<", "<=", ">", ">=", "==", "!=")[k % 6], k / 500) for k in range(600)]
    named = ['{"type":"species","operator":"%s","species":["a","x%d","B"]}' % (("in", "not_in")[k % 2], k) for k in range(400)]
    own = ['{"type":"detection_count","operator":">=","value":%d,"deviceId":"cam-1"}' % (k % 90) for k in range(900)]
    other = ['{"type":"detection_count","operator":">","value":0,"deviceId":"cam-2"}'] * 100
    listed = rule(spark, *shared, *sure, *named, *own, *other)
    for count, found in ((4, [("a", 0.5), ("b", 0.25), ("A", 0.125)]), (80, [("c", 0.5)]), (0, [])):
        hits = rules.candidates(event(spark, count, found), listed)
        top, classes = max((c for _, c in found), default=None), {n.lower() for n, _ in found}
        expected = [f"r{k}" for k in range(2000) if count > k % 7]
        compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "==": float.__eq__, "!=": float.__ne__}
        expected += [f"r{2000 + k}" for k in range(600) if found and compare[("<", "<=", ">", ">=", "==", "!=")[k % 6]](top, k / 500)]
        expected += [f"r{2600 + k}" for k in range(400) if found and bool(classes & {"a", f"x{k}", "b"}) == (k % 2 == 0)]
        expected += [f"r{3000 + k}" for k in range(900) if count >= k % 90]
        assert sorted(r.rule_id for r in hits.collect()) == sorted(expected)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Union" not in plan


def messages(spark, *rows):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), f"site/{d}/status", p) for i, (s, d, p) in enumerate(rows)],
        "seq long, ts timestamp, topic string, payload string",
    )


def test_message_classes(spark):
    rows = devices.classified(messages(
        spark, (0, "d", '{"ack":"ota_start"}'), (1, "d", '{"event":"ota_done"}'), (2, "d", '{"event":""}'),
        (3, "d", "[1]"), (4, "d", "null"), (5, "d", '{"online":0}'), (6, "d", '{"online":true,"ack":"x"}'),
    )).orderBy("seq", "part").collect()
    assert [(r.seq, r.category, r.type) for r in rows] == [
        (0, "ota", "ota_start"), (0, "ack", "ota_start"), (1, "ota", "ota_done"), (2, "event", "unknown"),
        (3, "unknown", None), (4, "unknown", None), (5, "presence", "offline"), (6, "presence", "online"),
    ]


def test_registry_ignores_what_comes_before_the_first_online_message(spark):
    rows = messages(
        spark, (0, "d", '{"event":"upload_ok"}'), (1, "d", '{"online":false}'), (2, "d", '{"online":true,"fw":"1","heap":5}'),
        (3, "d", '{"event":"upload_ok"}'), (4, "d", '{"online":true,"fw":"","auto":true}'), (5, "never", '{"event":"upload_ok"}'),
        (7200, "d", '{"online":false}'), (7300, "d", '{"online":true,"uptime":9}'), (7301, "d", '{"online":true}'),
        (7302, "d", '{"event":"upload_ok"}'),
    )
    found = devices.registry(rows, "2024-01-01 02:02:30").collect()
    assert len(found) == 1
    d = found[0]
    assert (d.online, d.stale, d.firmware, d.heap, d.auto_mode, d.uptime, d.interval_sec) == (True, False, "1", 5, True, 9, 30)
    assert d.image_count == 2 and d.online_since == dt.datetime(2024, 1, 1, 2, 1, 40)
    assert d.first_seen_at == dt.datetime(2024, 1, 1, 0, 0, 2)
    assert devices.registry(rows, "2024-01-01 02:10:00").first().stale
    earlier = devices.registry(rows, "2024-01-01 02:00:30").first()
    assert (earlier.online, earlier.online_since, earlier.stale) == (False, None, False)


def test_empty_shots_match_nothing(spark):
    raw = spark.createDataFrame(
        [("d", "", dt.datetime(2024, 1, 1), f"u/{i}.jpg", 1, "m", "image/jpeg") for i in range(3)],
        "device_id string, shot_id string, timestamp timestamp, image_url string, image_size long, image_md5 string, mime_type string",
    )
    enriched = event(spark, 2, [("a", 0.5)], "d").withColumns({
        "shot_id": F.lit(""), "annotated_image_url": F.lit("a"), "inference_model": F.lit("m"),
        "inference_version": F.lit("1"), "processing_time_ms": F.lit(1), "processed_at": F.col("timestamp"),
    })
    rows = gallery.with_detections(raw, enriched).collect()
    assert len(rows) == 3 and {r.detection_count for r in rows} == {0}


def test_numbering_is_dense_in_every_group(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'hot') as g", "cast(id as string) as k")
    out = ranking.numbered(df, ["g"], F.col("k"), ["k"]).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert set(part["group_size"]) == {len(part)}


def test_split_ratios(spark):
    images = spark.range(1000).selectExpr("'p' as project_id", "cast(id as string) as image_id")
    counts = {r.split: r["count"] for r in labeling.split(images).groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 200, "test": 100}
    assert labeling.split(images, seed="x").exceptAll(labeling.split(images)).count() > 0
    with pytest.raises(ValueError):
        labeling.split(images, 0.5, 0.2, 0.1)


def test_sketches_estimate_distinct_shots(spark, inputs):
    exact = {(r.device_id, r.aggregation_window): r.unique_shots for r in rollups.events_agg(inputs.events_raw, "daily").collect()}
    merged = rollups.read_combined(rollups.combine(rollups.partials(inputs.events_raw, "daily")))
    for r in merged.collect():
        assert abs(r.unique_shots - exact[r.device_id, r.aggregation_window]) <= 1


def test_invalid_arguments(spark, inputs):
    with pytest.raises(ValueError):
        rollups.events_agg(inputs.events_raw, "weekly")
    with pytest.raises(ValueError):
        rollups.query_rollup(inputs.events_raw, "weekly")


def test_patches_and_tombstones(spark):
    rows = spark.createDataFrame(
        [("a", 1, "create", "x", None), ("a", 2, "update", None, 5), ("b", 1, "update", "z", 1), ("c", 1, "create", "q", 1), ("c", 2, "delete", None, None)],
        "id string, at long, op string, name string, n int",
    )
    out = changes.patched(rows, "id", ["at"], ["name", "n"]).collect()
    assert [(r.id, r.name, r.n) for r in out] == [("a", "x", 5)]


def test_unknown_alert_change_has_no_effect(spark):
    opened = spark.createDataFrame([("a", "active")], "alert_id string, status string")
    change = spark.createDataFrame([("zzz", "resolved", dt.datetime(2024, 1, 1), "me")], "alert_id string, status string, changed_at timestamp, changed_by string")
    assert [(r.alert_id, r.status) for r in alerts.with_status(opened, change).collect()] == [("a", "active")]
