import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.operators import keyfilter, store, tables
from attesta.streaming import streams

SCHEMA = "id long, kind string, value string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_touches_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(2000).select("id", F.lit("k").alias("kind"), F.lit("old").alias("value"))
    store.write_table(old, path, ["id"], 128)
    whole = store.folder_bytes(spark, f"{path}/data")
    new = spark.createDataFrame([(i, "k", "new") for i in range(20)] + [(9000, None, None)], SCHEMA)
    seen = []

    def merge(before, more):
        seen.append(before.count())
        return store.replacing(["id"])(before, more)

    done = store.merge_table(new, path, merge)
    assert 1 <= len(done["buckets"]) <= 21 and done["bytes"] < whole / 4 and seen[0] < 2000 / 4
    want = [(i, "k", "new" if i < 20 else "old") for i in range(2000)] + [(9000, None, None)]
    assert rows_of(store.read_table(spark, path)) == want
    assert rows_of(store.read_table(spark, path, version=0)) == [(i, "k", "old") for i in range(2000)]
    state = store._state(spark, path)
    assert Counter(state["places"].values())[1] == len(done["buckets"])


def test_a_killed_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_table(spark.createDataFrame([(i, "k", "0") for i in range(50)], SCHEMA), path, ["id"], 8)
    new = spark.createDataFrame([(7, "k", "1"), (70, "k", "1")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(store, "put_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.merge_table(new, path, batch=0)
    assert rows_of(store.read_table(spark, path)) == [(i, "k", "0") for i in range(50)]
    store.merge_table(new, path, batch=0)
    want = sorted([(i, "k", "1" if i == 7 else "0") for i in range(50)] + [(70, "k", "1")])
    assert rows_of(store.read_table(spark, path)) == want
    assert store.merge_table(spark.createDataFrame([(7, "k", "2")], SCHEMA), path, batch=0)["buckets"] == []  # sent again
    assert rows_of(store.read_table(spark, path)) == want


def test_old_versions_and_empty_buckets_go(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_table(spark.createDataFrame([(i, "k", "0") for i in range(40)], SCHEMA), path, ["id"], 4)
    for k in range(1, 5):
        store.merge_table(spark.createDataFrame([(k, "k", str(k))], SCHEMA), path)
    assert store._versions(spark, path) == [3, 4]
    files = [p for p in (tmp_path / "t" / "data").rglob("*.parquet")]
    used = {(v, int(b)) for x in (3, 4) for b, v in store._state(spark, path, x)["places"].items()}
    assert {(int(p.parts[-3].split("=")[1]), int(p.parts[-2].split("=")[1])) for p in files} == used
    with pytest.raises(FileExistsError):
        store.write_table(spark.createDataFrame([], SCHEMA), path, ["id"])
    everything = spark.createDataFrame([(i, None, None) for i in range(40)], SCHEMA)
    store.merge_table(everything, path, lambda old, new: old.join(new.select("id"), "id", "left_anti"))
    assert store.read_table(spark, path).count() == 0
    store.merge_table(everything.limit(0), path)
    with pytest.raises(ValueError):
        store.write_table(spark.createDataFrame([(1,)], "_bucket int"), str(tmp_path / "u"), ["_bucket"])
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("bits", [32_768, 4])
def test_filter_has_all_hashes_that_were_added(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(keyfilter, "BITS", bits)  # 4: everything collides
    path = str(tmp_path / "f")
    keyfilter.create(spark, path, 4)
    hashes = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("h"))
    for k in range(2):
        keyfilter.add(hashes.limit(200 + 50 * k), "h", path, 4, 2, k)
    asked = spark.range(800).select(F.md5(F.col("id").cast("string")).alias("h"))
    maybe = {r.h for r in keyfilter.may_hold(asked, "h", path, 4, 2).collect()}
    added = {r.h for r in hashes.limit(250).collect()}
    assert added <= maybe and (len(maybe) == 800) == (bits == 4) and (bits == 4 or len(maybe) < 260)


REVIEWS = "review_id long, entity string, platform string, author string, content string"


def review_batches(seed):
    draw = random.Random(seed)
    rows = [(i, "e", draw.choice("pq"), draw.choice("ab"), draw.choice(["", " ", "text "]) + str(draw.randrange(40))) for i in range(120)]
    return [rows[:50], rows[50:55], rows[55:]]


@pytest.mark.parametrize("bits", [32_768, 8])
def test_batches_of_reviews_equal_one_ingest(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(keyfilter, "BITS", bits)
    path, batches = str(tmp_path / "r"), review_batches(1)
    for i, batch in [*enumerate(batches), (2, batches[2])]:
        streams.ingest_batch(spark.createDataFrame(batch, REVIEWS), i, path, 4, 2)
    want = tables.first_reviews(spark.createDataFrame(sum(batches, []), REVIEWS))
    assert rows_of(streams.read_reviews(spark, path).drop("batch_id")) == rows_of(want)
    # what nobody has said before is inserted without a look at the index
    fresh = streams.ingest_batch(spark.createDataFrame([(900, "e", "p", "a", "never said"), (901, "e", "p", "a", "nor this")], REVIEWS), 3, path, 4, 2)
    if bits > 8:
        assert fresh == {"inserted": 2, "maybe": 0, "buckets": []}
    else:
        assert fresh["inserted"] == 2 and fresh["maybe"] == 2 and fresh["buckets"]


def test_a_crash_between_the_tables_of_reviews_loses_nothing(spark, tmp_path, monkeypatch):
    path, batches = str(tmp_path / "r"), review_batches(2)
    for i, batch in enumerate(batches):
        for after in (1, 2):  # merges that go through before the crash: the filter's, or both
            count, real = [0], store.merge_table

            def merge(*a, **k):
                count[0] += 1
                if count[0] > after - 1 and after == 1 or count[0] > 1 and after == 2:
                    raise RuntimeError("killed")
                return real(*a, **k)

            with monkeypatch.context() as m:
                m.setattr(store, "merge_table", merge)
                with pytest.raises(RuntimeError):
                    streams.ingest_batch(spark.createDataFrame(batch, REVIEWS), i, path, 4, 2)
        streams.ingest_batch(spark.createDataFrame(batch, REVIEWS), i, path, 4, 2)
    want = tables.first_reviews(spark.createDataFrame(sum(batches, []), REVIEWS))
    assert rows_of(streams.read_reviews(spark, path).drop("batch_id")) == rows_of(want)


SOURCES = "url string, title string, site_name string, source_type string, published_at string, ord long"
FIELDS = (["title", "site_name", "source_type"], ["published_at"])


def source_rows(seed, n):
    draw = random.Random(seed)
    some = lambda *values: draw.choice([None, "", *values])
    return [(draw.choice([None, "", " https://a.x/1 "] + [f"https://h{k}.x/{k}" for k in range(30)]), some("t", "u"), some("s"), some("news", "forum"), some("2020"), i) for i in range(n)]


@pytest.mark.parametrize("cuts", [[60], [1, 2, 90], [40, 41, 42, 150]])
def test_batches_of_sources_equal_one_upsert(spark, tmp_path, cuts):
    path, rows = str(tmp_path / "s"), source_rows(3, 160)
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for i, part in enumerate(parts):
        for _ in range(1 + i % 2):  # every other batch is sent again
            streams.upsert_batch(spark.createDataFrame(part, SOURCES), i, path, *FIELDS, buckets=8)
    df = spark.createDataFrame(rows, SOURCES)
    key = lambda r: str(r)
    want = tables.upsert_sources(df.limit(0), df, *FIELDS)
    assert sorted(store.read_table(spark, path).collect(), key=key) == sorted(want.collect(), key=key)


def test_bytes_written_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    many = spark.range(20_000).selectExpr("concat('https://h.x/', id) AS url", "sha2(string(id), 256) AS title", "'s' AS site_name", "'news' AS source_type", "string(NULL) AS published_at", "id AS ord")
    first = streams.upsert_batch(many, 0, path, *FIELDS, buckets=256)
    one = streams.upsert_batch(many.where("id = 5"), 1, path, *FIELDS, buckets=256)
    ten = streams.upsert_batch(many.where("id < 10"), 2, path, *FIELDS, buckets=256)
    again = streams.upsert_batch(many.where("id < 10"), 2, path, *FIELDS, buckets=256)
    assert first["bytes"] > 20 * ten["bytes"] and ten["bytes"] > 5 * one["bytes"] > 0 and again["bytes"] == 0


def test_streams_of_reviews_and_sources(spark, tmp_path):
    rows = source_rows(4, 80)
    for k in range(2):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], SOURCES).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        stream = spark.readStream.schema(SOURCES).parquet(str(tmp_path / "src"))
        streams.stream_upsert_sources(stream, str(tmp_path / "out"), str(tmp_path / "cp"), *FIELDS, buckets=4).awaitTermination()
    df = spark.createDataFrame(rows, SOURCES)
    assert sorted(map(str, store.read_table(spark, str(tmp_path / "out")).collect())) == sorted(map(str, tables.upsert_sources(df.limit(0), df, *FIELDS).collect()))


EVENTS = "event_id long, review_id long, user_id long, score int, ts long"


def rating_rows(seed, n):
    draw = random.Random(seed)
    return [(i, draw.randrange(12), draw.randrange(5), draw.randrange(0, 7), draw.randrange(40)) for i in range(n)]


def by_hand(rows):
    last = {}
    for e, review, user, score, ts in rows:
        if 1 <= score <= 5 and last.get((review, user), (-1, -1))[:2] < (ts, e):
            last[review, user] = (ts, e, score)
    sums = {}
    for (review, _), (_, _, score) in last.items():
        sums.setdefault(review, []).append(score)
    return sorted((r, sum(s) / len(s), len(s)) for r, s in sums.items())


@pytest.mark.parametrize("cuts", [[100], [1, 30, 31, 150]])
def test_batches_of_ratings_equal_the_summary_of_all(spark, tmp_path, monkeypatch, cuts):
    path, rows = str(tmp_path / "r"), rating_rows(1, 200)
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for i, part in enumerate(parts):
        real, crash = store.merge_table, i % 3

        def merge(df, where, *a, **k):
            if crash and where.endswith("latest" if crash == 1 else "summary"):
                raise RuntimeError("killed")
            return real(df, where, *a, **k)

        with monkeypatch.context() as m:
            m.setattr(store, "merge_table", merge)
            if crash:
                with pytest.raises(RuntimeError):
                    streams.rating_batch(spark.createDataFrame(part, EVENTS), i, path, 4)
        for _ in range(2):
            streams.rating_batch(spark.createDataFrame(part, EVENTS), i, path, 4)
    assert rows_of(streams.read_rating_summary(spark, path)) == by_hand(rows)


def test_stream_of_ratings(spark, tmp_path):
    rows = rating_rows(2, 60)
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    streams.stream_ratings(stream, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4).awaitTermination()
    assert rows_of(streams.read_rating_summary(spark, str(tmp_path / "out"))) == by_hand(rows)
