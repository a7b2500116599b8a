import pytest
from pyspark.sql import functions as F

from fitforge.functions import text
from fitforge.operators import layout, maintenance, scoring, snapshots, terms, vectors
from fitforge.sources import boards
from fitforge.streaming import limits


def test_cosine_of_zero_vector_is_zero(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine("a", "b")).collect()] == [0.0, 1.0]


def test_combine_hands_on_missing_weights(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.5), (0.8, None, 0.0), (None, 0.6, None), (None, None, None)], "a double, b double, c double")
    found = [round(r[0], 4) for r in rows.select(scoring.combine(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert found == [50.0, 68.0, 60.0, 0.0]


def test_eligibility(spark):
    rows = spark.createDataFrame([(2, None), (3, None), (1, 8), (None, None)], "level int, years int")
    e = scoring.eligibility(F.col("level"), 1, F.col("years"), 5)
    found = rows.select(e["levels_above"], e["hidden"], F.round(e["multiplier"], 4)).collect()
    assert [tuple(r) for r in found] == [(1, False, 0.85), (2, True, 0.7225), (0, True, 1.0), (None, False, 1.0)]


def test_diff_of_a_snapshot_with_itself_is_unchanged(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", True)], "k int, content string, open boolean")
    assert {r["action"] for r in snapshots.diff(rows, rows, "k", "content", "open").collect()} == {"unchanged"}
    empty = rows.limit(0)
    assert {r["action"] for r in snapshots.diff(rows, empty, "k", "content", "open").collect()} == {"closed"}


def test_lists_and_pages(spark):
    lists = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "x array<string>")
    assert [r[0] for r in lists.select(text.english_list(F.col("x"))).collect()] == ["a, b and c", "a", ""]
    page = spark.createDataFrame([("<script>var t='</p>';</script><ul><li>A &amp;lt; B</li></ul>",)], "h string")
    assert page.select(text.html_to_text(F.col("h"))).first()[0].strip() == "• A &lt; B"


def test_boards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": [{"id": 7, "title": " T ", "absolute_url": "u", "location": {"name": "Remote, X"}, "content": "c", "first_published": "bad", "updated_at": "2024-01-02T03:04:05Z"}, {"id": 8, "title": "U", "absolute_url": "u", "location": null, "content": "c", "first_published": null, "updated_at": "2024-01-02T03:04:05Z"}]}')
    row, other = boards.normalise_a(boards.read_payloads(spark, str(tmp_path / "a.json"), boards.BOARD_A)).orderBy("external_id").collect()
    assert (row["external_id"], row["title"], row["is_remote"], row["posted_at"]) == ("7", "T", True, None)
    assert (other["location"], other["is_remote"], other["posted_at"].year) == (None, False, 2024)
    (tmp_path / "b.json").write_text('[{"id": "x", "text": "T", "hostedUrl": "u", "categories": {"location": " "}, "workplaceType": "remote", "createdAt": 0, "description": "d", "lists": [{"text": "L", "content": "<li>1</li>"}], "additional": ""}]')
    row = boards.normalise_b(boards.read_payloads(spark, str(tmp_path / "b.json"), boards.BOARD_B)).first()
    assert (row["location"], row["is_remote"], row["description"]) == (None, True, "d\n<h3>L</h3><ul><li>1</li></ul>")


def test_hourly_counts_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = limits.hourly_counts(stream, "user_id", "ts").writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, limits.hourly_counts(events, "user_id", "ts").collect()))


def test_upsert_never_revives(spark):
    stored = spark.createDataFrame([(1, "a", False), (2, "b", True)], "k int, name string, active boolean")
    incoming = spark.createDataFrame([(1, "A"), (3, "c")], "k int, name string")
    found = maintenance.upsert_names(stored, incoming, "k", "name", "active").collect()
    assert sorted(map(tuple, found)) == [(1, "A", False), (2, "b", True), (3, "c", True)]


def test_active_rows(spark):
    rows = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 20, True), (2, 21, False)], "g int, k int, active boolean")
    targets = spark.createDataFrame([(1, 11), (2, 99)], "g int, k int")
    found = {r["k"]: r["active"] for r in maintenance.activate(rows, targets, "g", "k", "active").collect()}
    assert found == {10: False, 11: True, 20: True, 21: False}  # the other group's target is not its own
    left = maintenance.delete_and_promote(rows, F.col("k") == 10, "g", "active", [F.desc("k")])
    assert {r["k"]: r["active"] for r in left.collect()} == {11: True, 20: True, 21: False}


def test_inserts_and_deletes(spark):
    stored = spark.createDataFrame([(1, 1, 0)], "u int, j int, at int")
    incoming = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 3)], "u int, j int, at int")
    found = {r["at"]: r["inserted"] for r in maintenance.insert_unique(stored, incoming, ["u", "j"], ["at"]).collect()}
    assert found == {1: False, 2: True, 3: False}
    left, answers = maintenance.delete_own(stored, spark.createDataFrame([(1, 1), (2, 1)], "u int, j int"), "u", "j")
    assert left.count() == 0 and {r["u"]: r["deleted"] for r in answers.collect()} == {1: True, 2: False}


def test_layout(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 5), (1, 9, 8)], "g int, a int, b int")
    found = {r["x"]: r["covered"] for r in layout.coverage_histogram(spans, "g", "a", "b").collect()}
    assert found == {0: 1, 1: 1, 2: 2, 3: 1, 5: 1}  # an interval that ends before it starts covers nothing
    pages = spark.createDataFrame([("d", 1, "Page 1\nx"), ("d", 2, " page 2\ny"), ("d", 3, None)], "d string, p int, t string")
    assert [tuple(r) for r in layout.repeated_lines(pages, "d", "p", "t").collect()] == [("d", "page #", 2)]
    sizes = spark.createDataFrame([(1, 10.0, 3), (1, 12.0, 2), (1, 12.0, 1)], "g int, size double, n int")
    assert tuple(layout.weighted_mode(sizes, "g", "size", F.col("n")).first()) == (1, 10.0, 3)


def test_nearest_of_each_query_and_no_query_dropped(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [0.0, 1.0]), (4, 0, [0.1, 1.0])], "vec_id long, label int, embedding array<double>")
    found = vectors.nearest_of_each(v, v.where("label = 0"), 1, "vec_id", F.col("label") != F.col("query_label")).collect()
    assert sorted((r["query_vec_id"], r["vec_id"]) for r in found) == [(1, 2), (4, 3)]
    with pytest.raises(Exception, match="one query row"):
        vectors.nearest(v, v.where("label = 0"), 1, "vec_id").collect()


def test_phrases_of_any_length(spark):
    docs = spark.createDataFrame([(1, "red green blue, green blue; red")], "doc_id long, text string")
    phrases = spark.createDataFrame([("red green blue",), ("green blue",), ("red",), ("blue",)], "phrase string")
    assert {r["phrase"]: r["mentions"] for r in terms.phrase_mentions(docs, phrases, "doc_id").collect()} == {"red green blue": 1, "green blue": 1, "red": 1}


def test_rows_that_an_order_leaves_open_are_no_difference(spark):
    kind = "k int, nth int, part int, flag string"
    was = [(1, 1, 1, "A"), (1, 1, 1, "R"), (2, 1, 1, "A"), (2, 1, 1, "A"), (3, 1, 2, "A"), (3, 2, 1, "R"), (4, 1, 1, "A")]
    now = [(1, 1, 1, "R"), (1, 1, 1, "A"), (2, 1, 1, "A"), (2, 1, 1, "R"), (3, 1, 2, "R"), (3, 2, 1, "A"), (4, 1, 1, "A"), (4, 1, 1, "A")]
    stored, parsed = (spark.createDataFrame(rows, kind).coalesce(1) for rows in (was, now))
    found = snapshots.lists_differ(stored, parsed, "k", ["nth", "part"], ["flag", "part"])
    assert sorted(map(tuple, found.collect())) == [(1, False), (2, True), (3, True), (4, True)]
    assert sorted(map(tuple, snapshots.lists_differ(stored, parsed, "k", "nth", ["flag", "part"]).collect())) == [(1, False), (2, True), (3, True), (4, True)]
