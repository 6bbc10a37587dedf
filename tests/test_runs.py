"""Ids of new entities, stored snapshots, and refresh runs that are killed between tables."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import ids, runs, store, tables
from attesta.plans import analysis, refresh, search


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_ids_are_gapless_and_the_same_on_rerun(spark, parts):
    names = [f"n{k:04d}" for k in random.Random(1).sample(range(9000), 500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(parts)
    got = {r.name: r.entity_id for r in ids.allocate_ids(df, ["name"], 41).collect()}
    assert got == {n: 42 + i for i, n in enumerate(sorted(names))}
    assert ids.allocate_ids(df.limit(0), ["name"], 41).count() == 0


ENTITIES = "entity_id long, name string, aliases array<string>"


def test_unknown_names_become_entities_with_their_alias(spark):
    e = spark.createDataFrame([(1, "a", ["x"]), (5, "b", [])], ENTITIES)
    k = spark.createDataFrame([(5, "kw", True), (1, "off", False)], "entity_id long, keyword string, is_active boolean")
    rows = [("a", "a2"), ("x", "a3"), ("kw", "b2"), ("new", "n1"), (" new ", "n2"), ("off", "o1"), ("new", "new"), ("", "z"), (None, "z"), ("a", " "), ("a", "x")]
    out = ids.register_names(e, k, spark.createDataFrame(rows, "canonical_name string, alias string"))
    assert rows_of(out.select("entity_id", "name", "aliases")) == rows_of(spark.createDataFrame([(1, "a", ["a2", "a3", "x"]), (5, "b", ["b2"]), (6, "new", ["n1", "n2"]), (7, "off", ["o1"])], ENTITIES))
    # the same call again changes nothing
    again = ids.register_names(out.select("entity_id", "name", "aliases"), k, spark.createDataFrame(rows, "canonical_name string, alias string"))
    assert rows_of(again.select("entity_id", "name", "aliases")) == rows_of(out.select("entity_id", "name", "aliases"))
    media = spark.createDataFrame([(1, "a", "c")], "id long, entity_name string, caption string")
    new = spark.createDataFrame([(2, " x", "c", "said"), (3, "fresh", "c", "")], "id long, entity_name string, caption string, comment string")
    files, everyone = ids.add_media(media, new, e, k)
    assert rows_of(files) == [(1, "a", "c"), (2, "a", "said"), (3, "fresh", "c")]
    assert [tuple(r) for r in everyone.where("name = 'fresh'").collect()] == [(6, "fresh", [])]


EVENTS = "entity_id long, search_mode string, query_id long, created_at string, body string"


@pytest.mark.parametrize("cuts", [[30], [1, 2, 60], [59]])
def test_stored_snapshots_equal_one_pass(spark, tmp_path, cuts):
    draw, path = random.Random(2), str(tmp_path / "s")
    rows = [(draw.randrange(4), draw.choice("mn"), i, f"2024-01-{1 + i // 4:02d}", draw.choice("ABC")) for i in range(80)]
    rows += [(9, "m", 100 + i, f"2024-02-0{1 + i}", b) for i, b in enumerate("ABA")]
    mixed = draw.sample(rows, len(rows))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        for _ in range(1 + i % 2):
            done = tables.save_snapshots(spark.createDataFrame(mixed[a:b], EVENTS), path, ["body"], i, 8)
    assert done["buckets"] == [] or i % 2 == 0
    want = tables.snapshot_history(spark.createDataFrame(rows, EVENTS), ["body"])
    got = store.read_table(spark, path).select("entity_id", "search_mode", "snapshot_hash", "version", F.col("last.created_at").alias("generated_at"), "is_latest")
    assert rows_of(got) == rows_of(want)
    assert [(r.version, r.is_latest) for r in got.where("entity_id = 9").orderBy("version").collect()] == [(1, True), (2, False)]


def test_published_runs(spark, tmp_path):
    path = str(tmp_path / "r")
    one = lambda *values: spark.createDataFrame([(v,) for v in values], "v long")
    runs.publish(spark, path, "r0", {"a": one(1), "b": one(10)}, appended=("a",))
    with pytest.raises(ZeroDivisionError):
        runs.publish(spark, path, "r1", {"a": one(2), "b": lambda done: 1 / 0}, appended=("a",))
    assert rows_of(runs.read(spark, path, "a")) == [(1,)]
    # what was finished before is kept, even if it would now be made otherwise
    runs.publish(spark, path, "r1", {"a": one(99), "b": lambda done: done["a"].select((F.col("v") * 10).alias("v"))}, appended=("a",))
    for _ in range(2):
        runs.publish(spark, path, "r1", {"a": one(5), "b": one(5)}, appended=("a",))
        assert rows_of(runs.read(spark, path, "a")) == [(1,), (2,)] and rows_of(runs.read(spark, path, "b")) == [(20,)]
    runs.publish(spark, path, "r2", {"b": one(30)})
    assert rows_of(runs.read(spark, path, "a")) == [(1,), (2,)] and rows_of(runs.read(spark, path, "b")) == [(30,)]
    assert sorted(p.name for p in (tmp_path / "r" / "data" / "b").iterdir()) == ["run=r1", "run=r2"]


WATCH = "entity_id long, name string, entity_type string, default_mode string, is_active boolean, priority int, refresh_interval_hours int, next_crawl_at timestamp_ntz, last_error_message string"
RESULTS = "entity_id long, search_mode string, pos int, ord long, url string, title string, content string, source string, published_date string"


@pytest.fixture(scope="module")
def inputs(spark):
    watch = [(i, f"Name{i}", "zoo", mode, True, i, 24, None, "old") for i, mode in ((1, "general"), (2, "general"), (3, "weird"), (5, "general"))]
    watch = spark.createDataFrame([*watch, (4, "Name4", "zoo", "general", False, 1, 24, None, None)], WATCH)
    templates = spark.createDataFrame([("zoo", "general", p, f"question {p} about it") for p in range(3)], "entity_type string, search_mode string, pos int, question string")
    queries = spark.createDataFrame([(1, "general", 70, "an earlier question")], "entity_id long, search_mode string, query_id long, question string")
    rows = [(e, "general", p, k, f"https://n{k}.example/a/{e}{p}{k}", f"A long title number {k}", f"Name{e} was seen in the news of page {k}, which is long enough.", "site", "2024-01-01") for e, p in ((1, 0), (1, 1), (2, 0), (5, 0), (5, 1), (4, 0)) for k in range(5)]
    return watch, templates, queries, spark.createDataFrame(rows, RESULTS)


def run(spark, path, run_id, inputs, as_of="2024-03-01 00:00:00"):
    watch, templates, queries, results = inputs
    return refresh.run_refresh(path, run_id, watch, templates, queries, results, search.SearchTerms(entity=("name",)), as_of, ["zoo"], due_limit=10)


TABLES = ("queries", "cards", "summaries", "snapshots", "suggestions", "outcomes", "watchlist")


def test_a_refresh_run_in_full(spark, tmp_path, inputs):
    path = str(tmp_path / "r")
    done = run(spark, path, "one", inputs)
    status = {r.entity_id: (r.status, r.answered, r.unanswered, r.invalid_modes) for r in done["outcomes"].collect()}
    assert status == {1: ("success", 2, 0, 0), 2: ("failed", 1, 1, 0), 3: ("skipped", 0, 0, 1), 5: ("success", 2, 0, 0)}
    assert [tuple(r) for r in refresh.refresh_totals(done["outcomes"]).collect()] == [("one", 4, 2, 1, 1, 1)]
    assert [(r.query_id, r.entity_id, r.pos) for r in done["queries"].orderBy("query_id").collect()] == [(71, 1, 0), (72, 1, 1), (73, 2, 0), (74, 2, 1), (75, 5, 0), (76, 5, 1)]
    after = {r.entity_id: (str(r.next_crawl_at), r.last_error_message) for r in done["watchlist"].collect()}
    assert after == {1: ("2024-03-02 00:00:00", None), 2: ("2024-03-01 01:00:00", "no results"), 3: ("None", "old"), 4: ("None", None), 5: ("2024-03-02 00:00:00", None)}
    asked = [r.question for r in done["suggestions"].where("entity_id = 1").orderBy("place").collect()]
    assert asked == ["question 0 about it", "question 1 about it", "question 2 about it", "an earlier question", refresh.FOLLOW_UP["general"]]
    assert {(r.entity_id, r.version) for r in done["snapshots"].where("is_latest").collect()} == {(1, 2), (2, 1), (5, 2)}
    # the next run finds the same: snapshots are refreshed, not repeated; ids go on
    run(spark, path, "two", inputs, "2024-03-09 00:00:00")
    assert runs.read(spark, path, "snapshots").count() == done["snapshots"].count() and {str(r.last.created_at)[:10] for r in runs.read(spark, path, "snapshots").collect()} == {"2024-03-09"}
    assert sorted(r.query_id for r in runs.read(spark, path, "queries").collect()) == list(range(71, 83))
    assert runs.read(spark, path, "cards").count() == 2 * done["cards"].count() > 0


def test_a_run_that_is_killed_between_tables_ends_as_one_that_was_not(spark, tmp_path, inputs, monkeypatch):
    clean, path = str(tmp_path / "clean"), str(tmp_path / "r")
    run(spark, clean, "one", inputs)
    for owner, name in ((analysis, "evidence_cards"), (analysis, "balanced_summary"), (tables, "merge_snapshots"), (tables, "refresh_suggestions"), (tables, "mark_refresh"), (runs, "put_text")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                run(spark, path, "one", inputs)
        assert runs.current(spark, path)["runs"] == []
    for _ in range(2):  # and once more after it was published
        run(spark, path, "one", inputs)
        for name in TABLES:
            assert rows_of(runs.read(spark, path, name)) == rows_of(runs.read(spark, clean, name))
