"""Contracts of single operators on tiny frames."""

from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderloom import contracts
from orderloom.operators import delivery, events, metrics, quality, rules
from orderloom.plans import outbox, pipeline, serving
from orderloom.settings import Settings
from orderloom.sources.files import wait_for
from orderloom.sources import versions
from orderloom.sources.versions import Conflict, VersionedTable

EVENT = {
    "eventId": "evt-001", "eventType": "ORDER_CREATED", "eventVersion": 1, "occurredAt": 1790894174.069822798, "producer": "p", "correlationId": "c",
    "customerId": "C1", "productId": "P1", "quantity": 5, "unitPrice": 79.90, "channel": " mobile ", "location": " sao_paulo ",
}


def raw(spark, *payloads):
    rows = [("k", p if isinstance(p, str) or p is None else json.dumps(p), "t", 0, i, dt.datetime(2026, 10, 1), dt.datetime(2026, 10, 1), dt.date(2026, 10, 1)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, contracts.RAW)


def test_trusted_row(spark):
    df = events.trusted_orders(raw(spark, EVENT))
    assert contracts.conforms(df, contracts.TRUSTED)
    row = df.first()
    assert (row.channel, row.location, row.revenue, row.unitPrice) == ("MOBILE", "SAO_PAULO", Decimal("399.50"), Decimal("79.90"))
    assert row.eventDate == dt.date(2026, 10, 1)


@pytest.mark.parametrize("payload", [
    EVENT | {"quantity": 0}, EVENT | {"unitPrice": -10}, "{oops", "null", "[1]", "", None, EVENT | {"occurredAt": "invalid"}, EVENT | {"occurredAt": "2026-09-29T18:14:32Z"},
    EVENT | {"occurredAt": "NaN"}, EVENT | {"quantity": 2.5}, EVENT | {"quantity": "2"}, EVENT | {"customerId": None}, {k: v for k, v in EVENT.items() if k != "productId"},
    EVENT | {"quantity": 2**31 - 1, "unitPrice": 99999999999999999.99},
])
def test_left_out(spark, payload):
    df = raw(spark, payload)
    assert events.trusted_orders(df).count() == 0
    assert events.reject_orders(df).first().reasons


def test_price_rounds_half_up_and_unknown_fields_are_ignored(spark):
    row = events.trusted_orders(raw(spark, EVENT | {"unitPrice": 10.005, "coupon": 1})).first()
    assert row.unitPrice == Decimal("10.01")


def test_invalid_copy_does_not_shadow(spark):
    df = events.first_of_each(events.trusted_orders(raw(spark, EVENT | {"quantity": 0}, EVENT | {"quantity": 1, "unitPrice": 100}, EVENT)), "eventId", "kafkaOffset")
    assert [r.revenue for r in df.collect()] == [Decimal("100.00")]


def orders(spark, rows):
    return spark.createDataFrame(rows, contracts.struct("eventId string, customerId string, productId string, quantity int, unitPrice decimal(19,2), revenue decimal(19,2), channel string, location string, eventDate date"))


D = Decimal


def test_daily_and_summary(spark):
    day = dt.date(2026, 10, 2)
    df = orders(spark, [("1", "a", "x", 2, D(100), D(200), "WEB", "SP", day), ("2", "a", "y", 1, D(50), D(50), "WEB", "SP", day), ("3", "b", "z", 3, D(100), D(300), "MOBILE", "RJ", day)])
    got = {r.channel: (r.totalOrders, r.totalItems, r.totalRevenue, r.averageOrderValue) for r in contracts.conforms(metrics.daily(df), contracts.DAILY).collect()}
    assert got == {"WEB": (2, 3, D("250.00"), D("125.00")), "MOBILE": (1, 3, D("300.00"), D("300.00"))}
    row = contracts.conforms(metrics.summary(df), contracts.SUMMARY).first()
    assert tuple(row)[:6] == (3, 6, D("550.00"), D("183.33"), 2, 3)


def test_aggregates_of_nothing_and_null_keys(spark):
    empty = orders(spark, [])
    row = metrics.summary(empty).first()
    assert (row.totalOrders, row.totalItems, row.averageOrderValue) == (0, None, None)
    df = orders(spark, [("1", "a", "x", 1, D(1), D(1), None, None, dt.date(2026, 1, 1))] * 2)
    assert metrics.daily(df).count() == 1 and metrics.daily(df).first().totalOrders == 1


def test_average_is_rounded_twice(spark):
    # 0.0049999... rounds to 0.005000 at six places and then up
    df = orders(spark, [(str(i), "a", "x", 1, D(0), D("0.01") if i < 1 else D(0), "W", "S", None) for i in range(2)])
    assert metrics.summary(df).first().averageOrderValue == D("0.01")


def test_gate(spark):
    kind = "eventId string, customerId string, productId string, quantity int, unitPrice double"
    good = spark.createDataFrame([("1", "a", "x", 1, 1.0), ("2", "a", "x", None, None)], kind)
    assert quality.gate(good)["totalRows"] == 2
    bad = spark.createDataFrame([("1", "a", "x", 1, 1.0), ("1", "a", "x", 1, 1.0), (None, None, None, 0, -1.0)], kind)
    with pytest.raises(quality.QualityError) as e:
        quality.gate(bad)
    assert e.value.failures == dict.fromkeys(quality.GATED, 1)
    assert quality.failures({"nullEventId": None}) == {} and quality.gate(good.limit(0))["totalRows"] == 0
    with pytest.raises(contracts.EmptyInput):
        contracts.not_empty(good.limit(0), "x")


@pytest.mark.parametrize("counts, fails", [((5, 5, 5), False), ((5, 4, 5), True), ((5, 5, 4), True)])
def test_reconcile(counts, fails):
    if fails:
        with pytest.raises(quality.ReconciliationError):
            quality.reconcile(*counts)
    else:
        assert quality.reconcile(*counts)["table"] == 5


def test_align(spark):
    got = contracts.align(spark.createDataFrame([("e", 2, 1)], "eventId string, quantity int, more int"), contracts.struct("eventId string, quantity int, dataQualityStatus string"))
    assert got.df.first().asDict() == {"eventId": "e", "quantity": 2, "dataQualityStatus": None}
    assert (got.added, got.dropped) == (("dataQualityStatus",), ("more",))


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", folders=True)
    df = spark.createDataFrame([(i, dt.datetime(2026, 1, 1 + i % 3)) for i in range(4)], "id int, occurredAt timestamp")
    assert not t.exists() and t.compare() is None
    first = t.create_or_replace(df)
    with pytest.raises(Conflict):
        t.create(df)
    assert t.compare() is None
    _, shaped = t.overwrite(df.union(df.limit(1)).withColumn("x", F.lit(1)))
    assert shaped.dropped == ("x",) and t.compare() == {"previous": 4, "current": 5}
    assert t.as_of(first.snapshot_id).count() == 4
    seen = t.current()
    t.append(df.limit(1))
    with pytest.raises(Conflict):  # made from a snapshot that isn't the current one any more
        t.overwrite(df, expected=seen)
    assert t.read().count() == 6 and len(t.current().folders) == 2
    t.overwrite(t.read().limit(5), expected=t.current())
    t.add_columns(note="string")
    assert t.read().columns == ["id", "occurredAt", "note"] and t.read().where("note is null").count() == 5
    assert [r.operation for r in t.history().collect()] == ["create", "overwrite", "append", "overwrite", "add columns"]
    with pytest.raises(Conflict):
        t._commit("late", ["x"], df.schema, first)
    t.append(df.limit(2).withColumn("note", F.lit("n")))
    assert t.read().where("note is null").count() == 5 and t.read().count() == 7
    before = sorted(map(str, t.read().collect()))
    t.compact()
    assert len(t.current().folders) == 1 and sorted(map(str, t.read().collect())) == before
    assert t.expire(keep=2) == 5 and len(t.history().collect()) == 2 and sorted(map(str, t.read().collect())) == before and t.compare() == {"previous": 7, "current": 7}
    assert len(list((tmp_path / "t" / "data").iterdir())) == len({f for s in t._entries() for f in s.folders})
    with pytest.raises(LookupError):
        t.as_of(1)


def test_appends_meet(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/meet", day_of=None)
    t.create(spark.range(2).toDF("id"))
    write, own = t._write, []

    def slow(df):  # another writer commits while this one writes
        path = write(df)
        if not own:
            own.append(1)
            VersionedTable(spark, t.path, day_of=None).append(spark.range(10, 13).toDF("id"))
        return path

    t._write = slow
    t.append(spark.range(5, 6).toDF("id"))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 5, 10, 11, 12]


def test_a_day_is_split(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/day")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # joins what is small, as this is
    spark.conf.set(key, "false")
    try:
        t.create(spark.range(20000).withColumn("occurredAt", F.lit(dt.datetime(2026, 1, 1))))
    finally:
        spark.conf.unset(key)
    sizes = [r["n"] for r in t.read().groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 15000


def test_stamps(spark):
    began = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=5)
    e = raw(spark, EVENT)
    out = events.trusted_orders(e)
    end = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(seconds=5)
    utc = lambda df, c: df.select(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    messages = spark.createDataFrame([(b"k", b"{}", "t", 0, 1, began)], contracts.MESSAGE)
    for df, c in ((out, "silverProcessedAt"), (events.envelope(messages), "ingestedAt"), (metrics.daily(out), "goldProcessedAt"), (metrics.summary(out), "goldProcessedAt")):
        assert began <= dt.datetime.fromisoformat(utc(df, c)) <= end, c


def test_catalog_settings():
    from orderloom.session import CONF, catalog_conf, prepared

    got = catalog_conf("lake", "s3a://w", "jdbc:postgresql://h/db", "u", "p")
    assert got["spark.sql.catalog.lake.warehouse"] == "s3a://w" and got["spark.sql.catalog.lake.uri"].startswith("jdbc:") and got["spark.sql.catalog.lake.jdbc.user"] == "u"
    assert "spark.sql.catalog.lake.jdbc.user" not in catalog_conf("lake", "w", "u")
    from unittest import mock

    fake = mock.MagicMock()
    prepared(fake)
    assert fake.conf.set.call_count == len(CONF)


def test_catalog_tables(spark, monkeypatch):
    from unittest import mock

    assert Settings(root="x", catalog="c", namespace="n", table="t").table_name == "c.n.t"
    spark.range(1).write.mode("overwrite").saveAsTable("known_here")
    assert versions.table_exists(spark, "spark_catalog.default", "known_here") and not versions.table_exists(spark, "default", "unknown")
    fake = mock.MagicMock()
    versions.catalog_as_of(fake, "c.n.t", 7)
    fake.sql.assert_called_once_with("SELECT * FROM c.n.t VERSION AS OF 7")
    versions.catalog_history(fake, "c.n.t")
    fake.table.assert_called_with("c.n.t.snapshots")
    for known in (False, True):
        df = mock.MagicMock()
        monkeypatch.setattr(versions, "table_exists", lambda *a, known=known: known)
        monkeypatch.setattr(versions, "align", lambda d, schema: mock.MagicMock(df=d))
        versions.register(df, "c", "n", "t")
        df.sparkSession.sql.assert_called_with("CREATE NAMESPACE IF NOT EXISTS `c`.`n`")
        df.writeTo.assert_called_once_with("`c`.`n`.`t`")
        assert df.writeTo().overwrite.called == known and df.writeTo().tableProperty().partitionedBy().create.called != known


def models(spark):
    day = dt.date(2026, 10, 2)
    df = orders(spark, [("1", "a", "x", 2, D(100), D(200), "WEB", "SP", day), ("2", "b", "y", 1, D(50), D(50), "MOBILE", "RJ", day - dt.timedelta(1))])
    return serving.summary_model(metrics.summary(df)), serving.daily_model(metrics.daily(df))


def test_publish_files_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/serving"
    store = serving.Store(spark, path)
    with pytest.raises(delivery.NotFound):
        store.summary()
    for _ in range(2):
        assert serving.publish_files(*models(spark), path) == serving.Published(1, 2)
    assert store.summary()["total_orders"] == 2 and store.summary()["id"] == 1
    assert [r.channel for r in store.daily().collect()] == ["WEB", "MOBILE"]
    assert store.daily(channel=" web ", start=dt.date(2026, 10, 2), end=dt.date(2026, 10, 2)).count() == 1
    assert store.daily(location="  ", limit=1).count() == 1
    for bad in ({"limit": 0}, {"limit": 1001}, {"start": dt.date(2026, 1, 2), "end": dt.date(2026, 1, 1)}):
        with pytest.raises(ValueError):
            store.daily(**bad)
    plan = store.daily(start=dt.date(2026, 10, 2))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_date), GreaterThanOrEqual(event_date" in plan and "TakeOrderedAndProject" in plan


def test_publications_keep_the_last_versions(spark, tmp_path):
    path = f"file://{tmp_path}/serving"
    serving.publish_files(*models(spark), path)
    reader = serving.Store(spark, path).daily()  # opened before the next ones
    for _ in range(2):
        serving.publish_files(*models(spark), path)
        assert reader.count() == 2
    serving.publish_files(*models(spark), path)
    assert len(list((tmp_path / "serving" / "versions").iterdir())) == 3
    assert serving.Store(spark, path).daily().count() == 2
    seen = serving.Watched(models(spark)[1].withColumn("channel", F.when(F.col("channel") == "WEB", F.col("channel"))), serving.rules.SERVED)
    seen.df.write.parquet(f"file://{tmp_path}/watched")
    assert seen.counts() == (2, 1)


def test_unservable_rows(spark, tmp_path):
    summary, daily = models(spark)
    with pytest.raises(contracts.ContractError):
        serving.publish_files(summary, daily.withColumn("channel", F.lit(None).cast("string")), f"file://{tmp_path}/s")
    with pytest.raises(contracts.ContractError):
        serving.publish_files(summary, daily.limit(0), f"file://{tmp_path}/s")


def test_publish_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    for _ in range(2):
        serving.publish_jdbc(*models(spark), url, "sales_summary", "sales_daily", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    summary, daily = models(spark)
    for bad in (daily.limit(0), daily.withColumn("channel", F.lit("x" * 51))):  # refused or failed, the old rows stay
        with pytest.raises(Exception):  # noqa: B017
            serving.publish_jdbc(summary.withColumn("total_orders", F.lit(9).cast("long")), bad, url, "sales_summary", "sales_daily", driver)
    assert spark.read.jdbc(url, "sales_summary", properties=driver).first()["total_orders"] == 2
    back = spark.read.jdbc(url, "sales_daily", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert back.count() == 2 and back.where("channel = 'WEB'").count() == 1


def test_replays(spark):
    kind = "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long"
    t = dt.datetime(2026, 1, 1)
    known = spark.createDataFrame([("a", "e0", t, 1)], kind)
    now = spark.createDataFrame([("a", "e1", t, 1), ("b", "e2", t, 5), ("b", "e3", t, 6)], kind)
    got = {r.eventId: (r.answeredId, r.replayed, r.payloadConflict) for r in delivery.accept(now, known).collect()}
    assert got == {"e1": ("e0", True, False), "e2": ("e2", False, False), "e3": ("e2", True, True)}
    odd = spark.createDataFrame([(None, "n1", t, 1), (None, "n1", t, 1), (None, "n2", t, 2), ("c", "e4", t, 1), ("c", "e4", t, None)], kind)
    rows = sorted((r.idempotencyKey or "", r.eventId, r.answeredId, r.replayed, r.payloadConflict) for r in delivery.accept(odd, known).collect())
    assert [x[:4] for x in rows] == [("", "n1", "n1", False), ("", "n1", "n1", False), ("", "n2", "n2", False), ("c", "e4", "e4", False), ("c", "e4", "e4", True)] and rows[-1][4]
    box = delivery.outbox_entries(delivery.accepted(delivery.accept(now, known)).withColumn("payload", F.lit("{}")))
    assert [r.id for r in delivery.next_batch(box).collect()] == ["e2"]
    failed = delivery.settle(box, spark.createDataFrame([("e2", "x" * 5000)], "id string, error string"))
    row = failed.first()
    assert (row.status, row.attempts, len(row.lastError)) == ("PENDING", 1, 2000)
    row = delivery.settle(failed, spark.createDataFrame([("e2", None)], "id string, error string")).first()
    assert (row.status, row.attempts, row.lastError) == ("PUBLISHED", 1, None) and row.publishedAt


def test_outbox_settles_into_its_history(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    store = outbox.Outbox(spark, f"file://{tmp_path}/outbox")
    settings = Settings(root=f"file://{tmp_path}", source_format="json", outbox_batch=2, outbox_settle=2, outbox_pause=0.0, outbox_give_up=2)
    kind = "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long, payload string"
    ask = lambda *rows: {r.eventId: (r.answeredId, r.replayed) for r in outbox.intake(store, spark.createDataFrame([(k, e, t + dt.timedelta(seconds=n), 1, "{}") for n, (k, e) in enumerate(rows)], kind)).collect()}
    assert ask(("a", "e0"), ("a", "e1"), ("b", "e2"), (None, "e3")) == {"e0": ("e0", False), "e1": ("e0", True), "e2": ("e2", False), "e3": ("e3", False)}

    def refuses(batch, settings):
        if not batch.where("id = 'e0'").isEmpty():
            raise OSError("refused")
        outbox.send(batch, settings)

    steps = iter([False] * 3 + [True])
    assert outbox.publish(spark, store, settings, lambda: next(steps), refuses) == 2
    state = lambda: {r.id: (r.status, r.attempts) for r in store.read().collect()}
    assert state() == {"e0": ("PENDING", 3), "e2": ("PUBLISHED", 0), "e3": ("PUBLISHED", 0)}
    assert [(r.id, r.epoch, r.attempts) for r in store.entries.read().collect()] == [("e0", 1, 3)] and store.results.read().count() == 0
    # keys of what went to the history are known, and what is settled twice counts once
    assert ask(("b", "e9"), ("c", "e8")) == {"e9": ("e2", True), "e8": ("e8", False)}
    store.history.append(store.history.read())
    outbox.publish_step(spark, store, settings)
    assert state() == {"e0": ("PUBLISHED", 3), "e2": ("PUBLISHED", 0), "e3": ("PUBLISHED", 0), "e8": ("PUBLISHED", 0)}
    plan = delivery.next_batch(store.waiting())._jdf.queryExecution().toString()
    assert "outbox/history" not in plan
    # a broker that is down costs a few sends, and entries that weren't tried keep their attempts
    ask(*[(None, f"f{i}") for i in range(8)])
    sends = []

    def down(batch, settings):
        sends.append(1)
        raise OSError("down")

    outbox.publish_step(spark, store, settings.but(outbox_batch=8, consumer_retries=0), down)
    assert len(sends) == 5 and sum(a for s, a in state().values() if s == "PENDING") == 2


def test_an_intake_that_lost_answers_anew(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    store = outbox.Outbox(spark, f"file://{tmp_path}/outbox")
    kind = "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long, payload string"
    row = lambda e: spark.createDataFrame([("k", e, t, 1, "{}")], kind)
    outbox.intake(store, spark.createDataFrame([("x", "e", t, 1, "{}")], kind))
    keys, raced = store.keys, []

    def late():
        before = keys()
        if not raced:
            raced.append(1)
            outbox.intake(outbox.Outbox(spark, f"file://{tmp_path}/outbox"), row("first"))
        return before

    store.keys = late
    assert [(r.answeredId, r.replayed) for r in outbox.intake(store, row("second")).collect()] == [("first", True)]
    assert sorted(r.id for r in store.read().collect()) == ["e", "first"]


def test_outbox_is_published_in_order_and_keeps_failures(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(f"e{i}", t + dt.timedelta(seconds=-i), "{}") for i in range(5)]
    store = outbox.Outbox(spark, f"file://{tmp_path}/outbox")
    entries = lambda rows: delivery.outbox_entries(spark.createDataFrame(rows, "eventId string, createdAt timestamp, payload string"))
    store.add(entries(rows))
    settings = Settings(root=f"file://{tmp_path}", source_format="json", outbox_batch=3)
    calls = []

    def broken(batch, _):
        calls.append([r.id for r in batch.collect()])
        raise OSError("down" * 1000)

    assert outbox.publish_step(spark, store, settings, broken) == {"sent": 0, "failed": 3}
    assert calls[0] == ["e4", "e3", "e2"] and calls.count(["e4"]) == 3  # the first try and two more
    state = {r.id: (r.status, r.attempts, len(r.lastError or "")) for r in store.read().collect()}
    assert state["e4"] == ("PENDING", 1, 2000) and state["e0"] == ("PENDING", 0, 0)

    def one_bad(batch, settings):  # and an entry that comes while the batch is sent
        if not store.read().where("id = 'new'").count():
            store.add(entries([("new", t + dt.timedelta(days=1), "{}")]))
        if batch.where("id = 'e3'").count():
            raise OSError("no")
        outbox.send(batch, settings)

    assert outbox.publish_step(spark, store, settings, one_bad) == {"sent": 2, "failed": 1}
    state = {r.id: (r.status, r.attempts, r.lastError) for r in store.read().collect()}
    assert state["new"][0] == "PENDING" and state["e3"] == ("PENDING", 2, "OSError: no") and state["e4"] == ("PUBLISHED", 1, None)
    assert outbox.publish_step(spark, store, settings) == {"sent": 3, "failed": 0}
    store.compact()
    assert outbox.publish_step(spark, store, settings) == {"sent": 1, "failed": 0}
    assert outbox.publish_step(spark, store, settings) == {"sent": 0, "failed": 0}
    sent = spark.read.schema(contracts.MESSAGE).json(settings.at("topic", settings.topic))
    assert sent.count() == 6 and {r.status for r in store.read().collect()} == {"PUBLISHED"} and all(r.publishedAt for r in store.read().collect())


def test_final_errors_are_not_retried():
    calls = []

    def run():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        delivery.retried(run, 2, 0)
    assert len(calls) == 1


def test_requests(spark):
    kind = "idempotencyKey string, customerId string, productId string, quantity int, unitPrice decimal(19,2), channel string, location string"
    df = spark.createDataFrame([("k", "c", "p", 1, D("0.01"), "WEB", "SP"), ("", "c" * 81, None, 0, D("0.00"), "w" * 31, " \t\n")], kind)
    good, bad = (r.reasons for r in rules.with_reasons(df, rules.REQUEST).collect())
    assert good == [] and bad == ["idempotencyKey_blank", "customerId_long", "productId_blank", "quantity_below_1", "unitPrice_below_0.01", "channel_long", "location_blank"]


def test_pipeline(spark, tmp_path):
    settings = Settings(root=f"file://{tmp_path}/lake")
    source = events.trusted_orders(raw(spark, EVENT, EVENT | {"eventId": "evt-002", "quantity": 1}))
    source.write.partitionBy("eventDate").parquet(settings.trusted)
    for _ in range(2):
        stages = pipeline.run(spark, settings)
    assert [s.status for s in stages] == ["done"] * 5 and stages[3].evidence == {"trusted": 2, "table": 2, "summary": 2}
    source.write.mode("append").partitionBy("eventDate").parquet(settings.trusted)
    with pytest.raises(pipeline.PipelineFailed) as e:
        pipeline.run(spark, settings)
    assert [s.status for s in e.value.stages] == ["failed"] + ["skipped"] * 4


def test_overwriting_drops_days_without_sales(spark, tmp_path):
    path = f"file://{tmp_path}/daily"
    df = orders(spark, [("1", "a", "x", 1, D(1), D(1), "W", "S", dt.date(2026, 1, d)) for d in (1, 2)])
    pipeline.write_daily(df, path)
    pipeline.write_daily(df.where("eventDate = date'2026-01-01'"), path)
    assert spark.read.parquet(path).select("eventDate").collect() == [(dt.date(2026, 1, 1),)]


def test_waiting(spark, tmp_path):
    wait_for(spark, f"file://{tmp_path}", 1)
    with pytest.raises(TimeoutError):
        wait_for(spark, f"file://{tmp_path}/none", 0.2, 0.05)


def test_random_events_against_a_plain_model(spark):
    rng = random.Random(5)
    payloads = []
    for i in range(300):
        e = EVENT | {"eventId": f"e{rng.randrange(150)}", "quantity": rng.choice([0, 1, 3, None]), "unitPrice": rng.choice([-1, 0, 2.5]), "customerId": rng.choice(["a", None])}
        payloads.append("{" if rng.random() < 0.1 else e)
    want: dict = {}
    for e in payloads:
        if isinstance(e, dict) and e["quantity"] and e["unitPrice"] >= 0 and e["customerId"]:
            want.setdefault(e["eventId"], D(str(e["unitPrice"])) * e["quantity"])
    got = events.first_of_each(events.trusted_orders(raw(spark, *payloads)), "eventId", "kafkaOffset").collect()
    assert {r.eventId: r.revenue for r in got} == {k: v.quantize(D("0.01")) for k, v in want.items()}


def test_intake_stores_each_accepted_request_once(spark, tmp_path):
    """Two requests without a key that name one event: two entries, as many as were accepted."""
    store = outbox.Outbox(spark, f"file://{tmp_path}/outbox")
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    outbox.intake(store, spark.createDataFrame([(None, "e", t, 1, "{}"), (None, "e", t, 2, "{}"), ("k", "f", t, 3, "{}")], "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long, payload string"))
    assert sorted((r.id, r.payloadHash) for r in store.entries.read().collect()) == [("e", 1), ("e", 2), ("f", 3)]
