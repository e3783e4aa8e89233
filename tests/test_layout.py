"""What the store's buckets, its reverse layout and its batch times spare: files read, shuffles, jobs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from pseudospark import ColumnMapping, MappingStore, depseudonymize, pseudonymize
from pseudospark.operators import lookup, store as module
from pseudospark.operators.store import BY_KEY, BY_PSEUDONYM, distinct_requests
from pseudospark.sources import files
from pseudospark.suite.common import mappings, namespaces


def people(spark, n, first=0, space="A", created="2024-01-01"):
    ids = spark.range(first, first + n)
    name = F.concat(F.lit("person "), F.col("id"))
    return mappings(ids, F.lit(space), name, F.concat(F.lit("p"), F.col("id")), F.lit(f"{created} 00:00:00"))


@pytest.fixture
def many(spark, workspace):
    """A store of 32 buckets with three batches of two namespaces."""
    store = MappingStore(spark, workspace.path("store"), workspace, buckets=32)
    for i in range(3):
        store.seed(people(spark, 400, 400 * i).unionByName(people(spark, 400, 400 * i, "B")), f"seed {i}")
    return store


def leaves(plan):
    """The scans of an executed plan, adaptive or not."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(plan.plan())
    children = plan.children()
    found = [leaf for i in range(children.size()) for leaf in leaves(children.apply(i))]
    return found or [plan]


def files_read(df):
    """Files that the scans of a collected table read, by the scans' own metrics."""
    execution = df._jdf.queryExecution()
    df._jdf.collectToPython()
    scans = [p for p in leaves(execution.executedPlan()) if p.getClass().getSimpleName() == "FileSourceScanExec"]
    return [(p.metrics().apply("numFiles").value(), p.metrics().apply("numOutputRows").value()) for p in scans]


class Saved:
    """A scratch place that shows what is written to it, before it is written."""

    def __init__(self, workspace):
        self.workspace, self.frames = workspace, {}

    def save(self, df, name):
        self.frames[name] = df
        return self.workspace.save(df, name)


def asked(spark, store, values, workspace, catalog, space="A"):
    requests = spark.createDataFrame([(space, v) for v in values], "namespace_name string, original_value string")
    return store.save_requests(distinct_requests(requests), catalog, workspace)


def test_few_requests_read_their_buckets(spark, many, workspace, catalog):
    all_files = files.glob(spark, f"{many.path}/generation=*/batch_id=*/namespace_name=A/*.parquet")
    assert len(all_files) > 60
    found = asked(spark, many, ["person 7", "person 500"], workspace, catalog)
    assert 1 <= len(found.buckets) <= 2
    scratch = Saved(workspace)
    matched, stats = many._match(found, many._committed(), None, {}, scratch)
    assert stats.get("misses") == 0 and matched.count() == 2
    own = [f for f in all_files if int(f.rsplit("_", 1)[1].split(".")[0]) in found.buckets]
    # Of three scans two read the requests; the store's reads the asked namespace's files of the asked buckets.
    read = sorted(n for n, _ in files_read(scratch.frames["matched"].select("original_value")))
    assert read[-1] == len(own) <= 6, (read, len(own))


def test_names_of_files_and_buckets_agree(spark, many):
    for layout in (BY_KEY, BY_PSEUDONYM):
        for bucket in (0, 13, 31):
            rows = many._scan(many._committed(), layout, [bucket])
            wrong = rows.where(layout.bucket(32) != bucket).count()
            assert rows.count() > 0 and wrong == 0
        assert many._scan(many._committed(), layout, []).count() == 0
        assert many._scan(many._committed(), layout, list(range(32))).count() == 2400


def exchanges_above_store(df):
    """Shuffles between the scan of a bucketed store and the top of the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    store = [i for i, line in enumerate(lines) if "stored_" in line or "Bucketed: true" in line]
    scan = max(i for i in store if "FileScan" in lines[i])
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    shuffles = 0
    for line in reversed(lines[:scan]):
        own = len(line) - len(line.lstrip(" :+-"))
        if line.strip() and own < depth:
            depth = own
            shuffles += "Exchange" in line
    assert "Bucketed: true" in text
    return shuffles


def test_many_requests_do_not_shuffle_the_store(spark, many, workspace, catalog):
    many.broadcast_bytes = 0
    values = [f"person {i}" for i in range(0, 2000, 3)]
    found = asked(spark, many, values, workspace, catalog)
    plans = {}

    class Plans(Saved):
        def save(self, df, name):
            plans[name] = exchanges_above_store(df), df._jdf.queryExecution().executedPlan().toString()
            return super().save(df, name)

    matched, stats = many._match(found, many._committed(), ["A"], {}, Plans(workspace))
    known = {v for v in values if int(v.split()[1]) < 1200}
    assert stats["misses"] == len(values) - len(known)
    assert {r.original_value for r in matched.where("pseudonym_value IS NOT NULL").collect()} == known
    assert plans["matched"][0] == 0 and "SortMergeJoin" in plans["matched"][1]

    wanted = spark.createDataFrame([("A", f"p{i}") for i in range(0, 2000, 7)], "namespace_name string, pseudonym_value string")
    wanted = workspace.save(wanted, "wanted")
    originals, _ = many.reverse_map(wanted, 1, Plans(workspace), ["A"])
    assert {r.original_value for r in originals.collect()} == {f"person {i}" for i in range(0, 1200, 7)}
    assert plans["originals"][0] == 0 and "SortMergeJoin" in plans["originals"][1]


def test_seeding_by_buckets(spark, many):
    many.broadcast_bytes = 0
    many.seed(people(spark, 500, 1000), "later")
    assert many.read(["A"]).count() == 1500
    assert many.read().groupBy("namespace_name", "original_value").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_odd_names_in_both_layouts(spark, workspace, limit):
    names = ["a/b c", "it's", "50%=x", "tab\tname", "ünï", "001", "back\\slash", "{x}"]
    catalog = namespaces(spark, **{n: ("Uuid4", 36) for n in names})
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=limit, buckets=4)
    requests = spark.createDataFrame([(n, v) for n in names for v in ("x", "y'")], "namespace_name string, original_value string")
    first = {tuple(r[:3]) for r in store.upsert(requests, catalog, "odd 'batch'/%").mappings.collect()}
    again = store.upsert(requests, catalog)
    assert again.created == 0 and {tuple(r[:3]) for r in again.mappings.collect()} == first
    back = store.reverse_many(store.read().select("namespace_name", "pseudonym_value"))
    assert {(r.namespace_name, r.original_value, r.pseudonym_value) for r in back.collect()} == first
    store.delete_namespace("it's")
    assert store.read().count() == 14
    assert store.reverse_many(store.read().select("namespace_name", "pseudonym_value")).count() == 14


def test_reverse_lookup_reads_one_bucket(spark, many):
    found = many.reverse_one("A", "p42")
    assert found.first().original_value == "person 42"
    assert sum(n for n, _ in files_read(many.reverse_one("A", "p42"))) <= 3
    assert many.reverse_one("nowhere", "p42").count() == 0


def test_reverse_layout_after_deletion_and_compaction(spark, many, catalog):
    asked_for = spark.createDataFrame(
        [("A", "p1"), ("A", "p999"), ("B", "p1"), ("A", "none")], "namespace_name string, pseudonym_value string"
    )

    def found():
        return {(r.namespace_name, r.original_value) for r in many.reverse_many(asked_for).collect()}

    assert found() == {("A", "person 1"), ("A", "person 999"), ("B", "person 1")}
    many.delete_namespace("B")
    assert found() == {("A", "person 1"), ("A", "person 999")}
    many.compact(buckets=5)
    assert found() == {("A", "person 1"), ("A", "person 999")}
    assert len(many._committed()) == 1 and many.buckets_of().number == 5
    many.drop_superseded()
    assert found() == {("A", "person 1"), ("A", "person 999")}
    places = files.glob(spark, f"{many.path}/generation=*") + files.glob(spark, f"{many.path}/reverse/generation=*")
    assert [p.rsplit("/", 1)[1] for p in places] == ["generation=000001.5"] * 2
    # New batches follow the new layout.
    request = spark.createDataFrame([("A", "person 3"), ("A", "new")], "namespace_name string, original_value string")
    assert many.upsert(request, catalog).created == 1


def test_failed_batch_leaves_nothing(spark, store, catalog, monkeypatch):
    request = spark.createDataFrame([("A", "x")], "namespace_name string, original_value string")
    monkeypatch.setattr(module, "observed", lambda seen: {**_seen(seen), "rows": 0})
    with pytest.raises(RuntimeError, match="1 keys were missing but 0 were stored"):
        store.upsert(request, catalog)
    assert store.read().count() == 0 and not files.glob(spark, f"{store.path}/_staged/*")


def _seen(seen):
    return {name: value for name, value in seen.get.items() if value is not None}


# -- jobs --------------------------------------------------------------------------------------------------------------


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_a_call(spark, store, workspace, catalog):
    df = workspace.save(spark.range(1000).selectExpr("cast(id % 700 AS string) AS v", "id"), "input")
    more = workspace.save(spark.range(1000).selectExpr("cast(id % 900 AS string) AS v", "id"), "more")
    mapped = [ColumnMapping("v", "A")]
    store.settings_of(catalog, ["A"])  # read once for a catalogue
    assert jobs_of(spark, lambda: pseudonymize(df, mapped, catalog, store)) <= 6
    assert jobs_of(spark, lambda: pseudonymize(df, mapped, catalog, store)) <= 6
    assert jobs_of(spark, lambda: pseudonymize(more, mapped, catalog, store)) <= 7  # some known, some new
    hidden = workspace.save(pseudonymize(df, mapped, catalog, store).df, "hidden")
    assert jobs_of(spark, lambda: depseudonymize(hidden, mapped, catalog, store)) <= 6


# -- pages -------------------------------------------------------------------------------------------------------------


def test_pages_read_the_newest_batches(spark, workspace, monkeypatch):
    store = MappingStore(spark, workspace.path("store"), workspace, buckets=2)
    for i in range(8):
        store.seed(people(spark, 30, 30 * i, created=f"2024-01-{i + 1:02d}"), f"day {i}")
    store.seed(people(spark, 5, space="B", created="2025-01-01"), "elsewhere")
    read = []
    scan = MappingStore._scan
    monkeypatch.setattr(MappingStore, "_scan", lambda s, folders, *a: read.append(len(folders)) or scan(s, folders, *a))
    page = lookup.stored_page(store, "A", size=10)
    assert read == [1]  # one reading, of the newest day
    rows = page.items.collect()
    assert len(rows) == 10 and {str(r.created_at)[:10] for r in rows} == {"2024-01-08"}

    read.clear()
    old = lookup.Cursor(spark.sql("SELECT timestamp'2024-01-03 00:00:00' AS t").first().t, "person 65")
    page = lookup.stored_page(store, "A", old, 10)
    assert sum(read) == 3  # newer days are left out: the third holds half of the page, then the two older ones are read
    assert page.next_cursor is not None


@pytest.mark.parametrize("compacted", [False, True])
def test_pages_are_those_of_a_whole_sort(spark, workspace, compacted):
    rng = random.Random(1)
    store = MappingStore(spark, workspace.path("store"), workspace, buckets=3)
    for i in range(6):
        rows = [
            ("A", f"v{i}-{k}", f"p{i}-{k}", rng.choice([None, f"2024-01-{rng.randrange(1, 9):02d}"])) for k in range(25)
        ]
        frame = spark.createDataFrame(rows, "namespace_name string, original_value string, pseudonym_value string, at string")
        at = F.col("at").cast("timestamp")
        store.seed(mappings(frame, F.col("namespace_name"), F.col("original_value"), F.col("pseudonym_value"), at), f"s{i}")
    if compacted:
        store.compact(slice_rows=20)
        assert len(store._committed()) >= 4
        times = [b for b in store.batches("A") if b.least is not None]
        assert all(later.least >= earlier.greatest for later, earlier in zip(times, times[1:]))
    for size in (7, 40):
        cursor = None
        for _ in range(4):
            whole = lookup.page(store.read(), "A", cursor, size)
            page = lookup.stored_page(store, "A", cursor, size, with_total=True)
            assert [tuple(r) for r in page.items.collect()] == [tuple(r) for r in whole.items.collect()]
            assert page.next_cursor == whole.next_cursor and page.total == 150
            cursor = page.next_cursor
            if cursor is None or cursor.created_at is None:
                break


def test_page_of_nothing(spark, store):
    page = lookup.stored_page(store, "A", with_total=True)
    assert page.items.count() == 0 and page.next_cursor is None and page.total == 0


def test_each_random_method_draws_for_its_own_rows(spark, store, workspace, monkeypatch):
    """The written plan has one Python evaluation for each method, each behind the filter of its rows."""
    plans = []
    save = MappingStore._save
    monkeypatch.setattr(
        MappingStore, "_save",
        lambda s, rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or save(s, rows, *a),
    )
    own = {"four": ("Uuid4", 36), "hex": ("FullRandomHexEncoded", 8), "sha": ("Sha256HexEncoded", 64)}
    rows = [(name, str(i)) for name in own for i in range(20)]
    requests = spark.createDataFrame(rows, "namespace_name string, original_value string")
    done = store.upsert(requests, namespaces(spark, **own))
    lengths = {(r.namespace_name, len(r.pseudonym_value)) for r in done.mappings.collect()}
    assert lengths == {("four", 36), ("hex", 8), ("sha", 64)} and done.created == 60
    assert plans[0].count("ArrowEvalPython") == 2 and "Union" in plans[0]


def rows_moved(spark, work):
    """Rows that ``work`` put into shuffles and rows that it wrote to files, by the stages' own metrics."""
    context = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        none = gateway.new_array(gateway.jvm.double, 0)
        found = context.statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    work()
    new = [s for key, s in stages().items() if key not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.outputRecords() for s in new)


def test_rows_moved_by_a_seed_and_a_compaction(spark, workspace):
    """Beside the two layouts a seed writes its rows once, a compaction not at all; that shuffles them once for each layout."""
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=0)
    rows = 5000
    store.seed(people(spark, rows), "first")
    _, written = rows_moved(spark, lambda: store.seed(people(spark, rows, rows), "second"))
    assert written < 3.1 * rows
    shuffled, written = rows_moved(spark, store.compact)
    assert shuffled < 2.1 * 2 * rows and written < 2.1 * 2 * rows
    assert store.read().where("pseudonym_value = concat('p', substring(original_value, 8))").count() == 2 * rows


def test_seed_of_some_known_keys(spark, workspace):
    """Keys that a large seed shares with the store keep the pseudonyms they have; the others come in whole."""
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=0)
    store.seed(people(spark, 500), "first")
    digests = people(spark, 1000).withColumn("pseudonym_value", F.upper(F.sha2("pseudonym_value", 256)))
    store.seed(digests, "second")
    assert rows_moved(spark, lambda: store.seed(digests, "third"))[1] < 1100
    store.compact()
    found = store.read().withColumn("id", F.substring("original_value", 8, 9).cast("long"))
    plain = F.concat(F.lit("p"), F.col("id"))
    kept = F.when(F.col("id") < 500, plain).otherwise(F.upper(F.sha2(plain, 256)))
    assert found.count() == found.where(F.col("pseudonym_value") == kept).count() == 1000


def test_compaction_keeps_the_smallest_of_equals(spark, workspace):
    """Rows of one key and time, as writers at a time leave them: the smallest pseudonym stays, however it is moved."""
    store = MappingStore(spark, workspace.path("store"), workspace)
    pseudonyms = ["x" + "AB" * 9, "AB" * 9 + "x", "AB" * 9, "AB" * 8]
    for i, pseudonym in enumerate(pseudonyms):
        one = people(spark, 3).withColumn("pseudonym_value", F.lit(pseudonym))
        store._write(f"{store.path}/{store._generation()}/batch_id=writer-{i}", one)
    assert store.read().count() == 12
    store.compact()
    assert [r.pseudonym_value for r in store.read().collect()] == [min(pseudonyms)] * 3


def test_wide_rows_are_not_dealt(spark, workspace, monkeypatch):
    """Whole texts are shuffled once, to find the distinct ones, and each bucket's files hold rows of that bucket only."""
    monkeypatch.setattr(module, "ONE_TASK_ROWS", 10)
    store = MappingStore(spark, workspace.path("store"), workspace)
    plans = []
    save = store._save
    monkeypatch.setattr(store, "_save", lambda rows, *rest: (plans.append(str(rows._jdf.queryExecution().optimizedPlan())), save(rows, *rest)))
    texts = spark.range(400).select(F.lit("texts").alias("namespace_name"), F.repeat(F.concat(F.col("id"), F.lit(" ")), 300).alias("original_value"))
    done = store.upsert(texts.union(texts), namespaces(spark, texts=("Sha256HexEncoded", 64)))
    assert done.created == 400 and done.mappings.where("pseudonym_value = upper(sha2(original_value, 256))").count() == 400
    assert len(plans) == 2 and not [p for p in plans if "Repartition" in p or "Rebalance" in p]
    for layout in (BY_KEY, BY_PSEUDONYM):
        rows = [store._scan(store._committed(), layout, [b]).where(layout.bucket(8) == b).count() for b in range(8)]
        assert sum(rows) == 400
    assert not files.glob(spark, f"{done.scratch.root}/*/requests-*")


def test_writes_leave_no_shuffle_files(spark, workspace):
    """The setting that has them deleted holds while tables are written, by however many at a time."""
    name = files._FREES_SHUFFLES
    seen = []
    with files.shuffles_freed(spark):
        with files.shuffles_freed(spark):
            seen.append(spark.conf.get(name))
        seen.append(spark.conf.get(name))
    assert seen == ["true", "true"] and spark.conf.get(name) == "false" and not files._writers

    def shuffles():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    spark.sparkContext._jvm.System.gc()
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    left = shuffles()
    assert workspace.save(rows, "rows").count() == 100
    assert shuffles() <= left + 1  # that of the count


def moved_columns(plan):
    """The columns of each shuffle that a plan asks for by itself."""
    children = plan.children()
    found = [c for i in range(children.size()) for c in moved_columns(children.apply(i))]
    if not plan.nodeName().startswith("Repartition") and not plan.nodeName().startswith("Rebalance"):
        return found
    output = plan.output()
    return [sorted(output.apply(i).name() for i in range(output.size())), *found]


@pytest.mark.parametrize("buckets", [4, 6])
def test_keys_alone_are_dealt_to_both_layouts(spark, workspace, monkeypatch, buckets):
    """Computed pseudonyms, times and settings are added where rows are written; a task writes one bucket."""
    monkeypatch.setattr(module, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(module, "TASK_BYTES", 20_000)
    store = MappingStore(spark, workspace.path("store"), workspace, buckets=buckets)
    plans = []
    save = store._save
    monkeypatch.setattr(store, "_save", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().optimizedPlan()), save(rows, *rest)))
    catalog = namespaces(spark, a=("Sha256HexEncoded", 64, "p-"), b=("Sha256HexEncoded", 64, None, "-s"))
    df = spark.range(1500).select(F.col("id").cast("string").alias("x"), (F.col("id") % 7).cast("string").alias("y"))
    mapped = [ColumnMapping("x", "a"), ColumnMapping("x", "b", "xb"), ColumnMapping("y", "b", "yb")]
    result = pseudonymize(df, mapped, catalog, store)
    keys = ["namespace_name", "original_value"]
    assert [moved_columns(p) for p in plans] == [[keys], [keys]]
    digest = F.upper(F.sha2("original_value", 256))
    own = F.when(F.col("namespace_name") == "a", F.concat(F.lit("p-"), digest)).otherwise(F.concat(digest, F.lit("-s")))
    for layout in (BY_KEY, BY_PSEUDONYM):
        rows = store._scan(store._committed(), layout).withColumn("file", F.input_file_name())
        assert rows.where(F.col("pseudonym_value") == own).count() == rows.select(*keys).distinct().count() == 3000
        assert rows.select("created_at", "last_updated_at").distinct().count() == 1
        task = F.regexp_extract("file", "part-([0-9]+)", 1)
        written = rows.groupBy(task.alias("task")).agg(F.countDistinct(layout.bucket(buckets)).alias("n")).collect()
        assert len(written) > buckets and {r.n for r in written} == {1}
        assert all(store._scan(store._committed(), layout, [b]).where(layout.bucket(buckets) != b).isEmpty() for b in range(buckets))
    age = store.read().select(F.unix_micros(F.current_timestamp()) - F.unix_micros("created_at")).first()[0]
    assert 0 <= age < 600_000_000
    assert not files.glob(spark, f"{result.scratch.root}/*")
    shown = result.df.join(df.select(F.concat(F.lit("p-"), F.upper(F.sha2("x", 256))).alias("x"), "y"), ["x", "y"])
    assert shown.where("yb = concat(upper(sha2(y, 256)), '-s')").count() == 1500


def test_dealing_by_buckets(store):
    """One bucket a task where there are many tasks, whole shares of the buckets where there are few."""
    for buckets in (1, 7, 8, 12, 4096):
        for rows in (30_000, 1_000_000, 10_000_000):
            tasks = store._tasks(rows, rows * 70, buckets)
            assert tasks % buckets == 0 or buckets % tasks == 0
            assert tasks * module.TASK_BYTES >= rows * (70 + module.ADDED_BYTES)
    assert store._tasks(10_000_000, 10_000_000 * 70, 8) == 16
    assert store._tasks(30_000, 30_000 * 70, 4099) < 100
