import json
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.functions import fixed
from pairloom.operators import convert, metrics, order
from pairloom.plans import inputs as I
from pairloom.session import fresh_path
from pairloom.sources import pairs as P
from pairloom.sources import report as R
from pairloom.streaming import curate as S
from tests.conftest import SMALL

LINES = [
    ('{"output":"天","input":"ア"}', ("天", "ア")),
    ('  {"input":"ア","output":"天","left_context":{"x":[1]}} \t', ("天", "ア")),
    ('{"output":"q\\u0041\\n","input":"\\ud83d\\ude00"}', ("qA\n", "😀")),
    ('{"output":"1","input":"2020-01-01"}', ("1", "2020-01-01")),
    ('{"output":"a","output":"z","input":"b"}', ("z", "b")),
    ('{"output":"","input":" "}', ("", " ")),
    ('{"output":1,"input":"x"}', None),
    ('{"output":true,"input":"x"}', None),
    ('{"output":null,"input":"x"}', None),
    ('{"output":["a"],"input":"x"}', None),
    ('{"output":{"a":1},"input":"x"}', None),
    ('{"output":"a"}', None),
    ('{"Output":"a","input":"b"}', None),
    ('{"output":"a","input":"b"', None),
    ('{"output":"a","input":"b"} x', None),
    ('{"output":"a","input":"b"}{"output":"c","input":"d"}', None),
    ('{"output":"a","input":"b"},{"output":"c","input":"d"}', None),
    ('[{"output":"a","input":"b"}]', None),
    ("{'output':'a','input':'b'}", None),
    ('"text"', None),
    ("", None),
    ("null", None),
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(x for x, _ in LINES) + "\n", encoding="utf-8")
    return tmp_path


def test_expectations_agree_with_json():
    for line, expected in LINES:
        try:
            record = json.loads(line)
            got = (record["output"], record["input"])
            got = got if all(isinstance(x, str) for x in got) else None
        except (ValueError, KeyError, TypeError):
            got = None
        assert got == expected, line


def test_parse(spark, folder):
    found = P.read_pairs_jsonl(spark, [str(folder / "a.jsonl")]).orderBy(*P.FILE_ORDER).collect()
    good = [e for _, e in LINES if e]
    assert [(r.kanji_text, r.katakana_text) for r in found] == good
    lines = spark.read.text(str(folder))
    kept = P.parse_pairs(lines, keep_bad=True)
    assert kept.count() == len(LINES)
    assert kept.where("kanji_text IS NULL AND katakana_text IS NULL").count() == len(LINES) - len(good)


def test_parse_happens_once(spark, folder):
    read = P.read_pairs_jsonl(spark, [str(folder)]).where(F.length("kanji_text") < 5)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_files_in_order_and_missing(spark, tmp_path):
    for name, lines in (("b", ["1", "", "2"]), ("a", ["3"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / n) for n in ("b", "gone", "a")]
    scanned, missing = P.scan_files(spark, paths)
    ordered = scanned.orderBy(*P.FILE_ORDER).select("file_ord", "value")
    assert [tuple(r) for r in ordered.collect()] == [(0, "1"), (0, ""), (0, "2"), (2, "3")]
    assert missing == paths[1:2]
    assert P.scan_files(spark, paths[1:2]) == (None, paths[1:2])
    with pytest.raises(FileNotFoundError):
        P.read_pairs_jsonl(spark, paths[1:2])


def test_cap_takes_lines_as_they_stand(spark, tmp_path):
    """Files of several splits: the prefix is exact and keeps the order."""
    texts = {n: [f"{n}{i}" * 20 for i in range(3000)] for n in "ba"}
    for n, values in texts.items():
        lines = [json.dumps({"output": v, "input": v}) for v in values]
        (tmp_path / n).write_text("\n".join(lines) + "\n")
    expected = texts["b"] + texts["a"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        read = P.read_pairs_jsonl(spark, [str(tmp_path / n) for n in "ba"])
        assert read.select("split_pos").distinct().count() > 6
        for n in (10, 3000, 3500, 9999):
            capped = order.first_n(read, n, P.FILE_ORDER).select("row_idx", "kanji_text")
            assert sorted(map(tuple, capped.collect())) == list(enumerate(expected[:n]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_sampled_before_parsing(spark, folder):
    paths = [str(folder / "gone"), str(folder / "a.jsonl")]
    with pytest.warns(P.MissingInput, match="gone"):
        sampled = P.read_pairs_jsonl(spark, paths, 0.5, seed=4)
    good = [e for _, e in LINES if e]
    assert all((r.kanji_text, r.katakana_text) in good for r in sampled.collect())
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert plan.index("from_json") < plan.index("md5")  # the filter is below the parse


def test_text_lines(spark, tmp_path):
    (tmp_path / "t").write_text("　a \n\n \t\nb \n", encoding="utf-8")
    assert sorted(r.text for r in P.read_text_lines(spark, str(tmp_path / "t")).collect()) == ["a", "b"]


def test_cache_builds_once_and_again_after_a_broken_write(spark, tmp_path):
    path, built = str(tmp_path / "cache"), []

    def build():
        built.append(1)
        return spark.range(5)

    assert P.cached(spark, path, build).count() == 5
    assert P.cached(spark, path, build).count() == 5 and len(built) == 1
    foreign = str(tmp_path / "foreign")
    spark.range(3).write.parquet(foreign)
    (tmp_path / "foreign" / "_SUCCESS").unlink()
    assert P.cached(spark, foreign, build).count() == 3 and len(built) == 1  # never replaced

    def beaten():
        spark.range(7).write.parquet(str(tmp_path / "raced"))
        return spark.range(5)

    assert P.cached(spark, str(tmp_path / "raced"), beaten).count() == 7
    assert [p.name for p in tmp_path.iterdir() if P.BUILDING in p.name] == []


def test_equal_lines_are_sampled_one_by_one(spark, tmp_path):
    line = json.dumps({"output": "a", "input": "b"})
    (tmp_path / "same.jsonl").write_text(f"{line}\n" * 4_000)
    drawn = P.read_pairs_jsonl(spark, [str(tmp_path / "*.jsonl")], 0.25, seed=1).count()
    assert 800 < drawn < 1_200


def test_many_paths_make_one_scan(spark, tmp_path):
    for k in range(500):
        (tmp_path / f"p{k} x").write_text(f"{k}\n")
    paths = [str(tmp_path / f"p{k} x") for k in reversed(range(500))]
    scanned, missing = P.scan_files(spark, [*paths, str(tmp_path / "p1? x"), str(tmp_path)])
    assert missing == []
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rows = [tuple(r) for r in scanned.orderBy(*P.FILE_ORDER).select("file_ord", "value").collect()]
    assert rows[:500] == [(i, str(499 - i)) for i in range(500)]
    assert rows[500:510] == [(500, str(k)) for k in range(10, 20)]
    assert len(rows) == 1010


def test_folder_is_read_file_by_file(spark, tmp_path):
    for name in "cab":
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        scanned, _ = P.scan_files(spark, [str(tmp_path)])
        got = [r.value for r in scanned.orderBy(*P.FILE_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{name}{i}" for name in "abc" for i in range(400)]


def test_dataset_split_is_pruned(spark, tmp_path):
    frame = spark.range(10).select("id", F.when(F.col("id") < 3, "test").otherwise("train").alias("split"))
    P.write_dataset(frame, str(tmp_path), "sums", "main")
    read = P.read_dataset(spark, str(tmp_path), "sums", "test", "main")
    assert sorted(r.id for r in read.collect()) == [0, 1, 2]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_report(spark, tmp_path):
    data = [(0, "今日は", "キョウハ", 0.5), (1, "天気", "エラー: x", 0.0)]
    results = spark.createDataFrame(data, "seq long, text string, output string, seconds double")
    path = str(tmp_path / "report")
    R.write_report(R.report_lines(results), path)
    parts = sorted(Path(path).glob("part-*"))
    assert "".join(p.read_text(encoding="utf-8") for p in parts).split("\n") == [
        "📊 総処理時間: 0.500秒", "⚡ 平均処理時間: 0.250秒/文", "🚀 平均処理速度: 10.0 文字/秒",
        "=" * 60, "",
        "入力: 今日は", "出力: キョウハ", "推論時間: 0.500秒", "処理速度: 6.0 文字/秒", "-" * 40,
        "入力: 天気", "出力: エラー: x", "-" * 40, "",
    ]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.jsonl").write_text("\n".join(x for x, _ in LINES) + "\n", encoding="utf-8")
    out = fresh_path(spark, "stream")
    lines = S.read_lines(spark, str(source), files_per_trigger=1)
    S.start_curation(lines, f"{out}/t", f"{out}/c").awaitTermination()
    batch = S.curated(spark.read.text(str(source)))
    streamed = spark.read.parquet(f"{out}/t")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() == 20

    S.start_counts(lines, f"{out}/n", f"{out}/nc").awaitTermination()
    counts = {r.reason: r.n_rows for r in S.latest_counts(spark, f"{out}/n").collect()}
    assert counts == {"bad_record": 64, "blank": 4, "kept": 20}

    # A file that comes later is added to both.
    (source / "late.jsonl").write_text('{"output":"天","input":"ア"}\n', encoding="utf-8")
    S.start_curation(lines, f"{out}/t", f"{out}/c").awaitTermination()
    S.start_counts(lines, f"{out}/n", f"{out}/nc").awaitTermination()
    assert spark.read.parquet(f"{out}/t").count() == 21
    counts = {r.reason: r.n_rows for r in S.latest_counts(spark, f"{out}/n").collect()}
    assert counts == {"bad_record": 64, "blank": 4, "kept": 21}


def make_picky():
    sizes = []

    def convert_batch(texts):
        sizes.append(len(texts))
        if max(sizes) > 4:
            raise RuntimeError("batch too large")
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    return convert_batch


def test_conversion_isolates_failures(spark):
    data = [(i, None if i == 5 else f"{'bad' if i % 10 == 3 else 'ok'}{i}") for i in range(40)]
    frame = spark.createDataFrame(data, "id int, text string").repartition(3)
    done = convert.batch_convert(frame, "text", make_picky, batch_size=4).collect()
    assert len(done) == 40
    for row in done:
        if row.id == 5:
            assert row.error and row.seconds == 0
        elif row.id % 10 == 3:
            assert (row.output, row.seconds, row.error) == ("エラー: bad text", 0.0, "bad text")
        else:
            assert row.output == row.text.upper() and row.error is None and row.seconds >= 0


def test_wrong_number_of_outputs_is_an_error(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    done = convert.batch_convert(frame, "text", lambda: lambda texts: texts[:1]).collect()
    assert [r.output for r in done] == ["a", "b"]


def test_zero_arrays_fail(spark):
    frame = spark.createDataFrame([("a", [0.0, 1.0]), ("a", [0.0]), ("b", [0.0])], "k string, v array<float>")
    found = {r.k: (r.zero_fraction, r.all_zero) for r in metrics.zero_fraction(frame, "k", "v").collect()}
    assert found == {"a": (pytest.approx(2 / 3), False), "b": (1.0, True)}
    assert metrics.require_nonzero(frame.where("k = 'a'"), "k", "v").count() == 1
    with pytest.raises(Exception, match="all values are zero for b"):
        metrics.require_nonzero(frame, "k", "v").select("k").collect()


def test_speeds_without_time(spark):
    frame = spark.createDataFrame([("abc", 0.0, "a")], "text string, seconds double, mode string")
    assert metrics.throughput(frame).first().chars_per_second is None
    assert tuple(metrics.compare_speed(frame, "a", "b").first()) == (None, None, None)


def test_fixed_values():
    assert len(fixed.UNWANTED_PHRASES) == 30 and len(fixed.EXPLANATIONS) == 8


def test_a_sample_of_lines_does_not_follow_the_splits(spark, tmp_path):
    for name, n in (("b.jsonl", 4_000), ("a.jsonl", 300)):
        lines = [json.dumps({"output": f"{name} {k // 2}", "input": "x" * (k % 40)}) for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    seen = []
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    try:
        for size in ("128m", "20k", "7k"):
            spark.conf.set(conf, size)
            drawn = P.read_pairs_jsonl(spark, [str(tmp_path)], rate=0.3, seed=5, line_numbers=True)
            seen.append(sorted((r.file, r.line_no, r.copy, r.kanji_text) for r in drawn.collect()))
        (tmp_path / "0.jsonl").write_text('{"output":"new","input":"y"}\n' * 50, encoding="utf-8")
        drawn = P.read_pairs_jsonl(spark, [str(tmp_path)], rate=0.3, seed=5, line_numbers=True)
        seen.append(sorted((r.file, r.line_no, r.copy, r.kanji_text) for r in drawn.where("kanji_text <> 'new'").collect()))
    finally:
        spark.conf.set(conf, before)
    assert seen[0] == seen[1] == seen[2] == seen[3]
    assert 1_100 < len(seen[0]) < 1_500
    for file, line_no, copy, text in seen[0]:
        assert text == f"{file.rpartition('/')[2]} {line_no // 2}" and copy == 0
    twice, _ = P.scan_files(spark, [str(tmp_path / "a.jsonl"), str(tmp_path)], line_numbers=True)
    places = [(r.file, r.line_no, r.copy) for r in twice.collect()]
    assert len(places) == len(set(places)) == 300 + 4_350


def record_texts(folder):
    return sorted(line for f in Path(folder).glob("part-*") for line in f.read_text().splitlines())


def test_record_files_grow_in_number(spark, monkeypatch):
    few = I.record_files(spark, SMALL, 4)
    monkeypatch.setattr(I, "PART_BYTES", 20_000)
    many = I.record_files(spark, SMALL, 4)
    assert len([*Path(few).glob("part-*")]) == 4 < len([*Path(many).glob("part-*")])
    assert record_texts(few) == record_texts(many)
    assert I.n_parts(spark, SMALL, 4) > 4


@pytest.mark.parametrize("name", ["cap_across_files", "sample_before_parse", "stream_curate", "stream_counts"])
def test_lines_are_dealt_before_records_are_made(spark, monkeypatch, name):
    """Records are six times as long as lines, so no exchange sends them; a small part size changes nothing."""
    wanted = sorted(entry.queries()[name](spark, SMALL).collect(), key=str)
    monkeypatch.setattr(I, "PART_BYTES", 20_000)
    plans, write = [], DataFrameWriter.text

    def text(writer, path, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", text)
    assert sorted(entry.queries()[name](spark, SMALL).collect(), key=str) == wanted
    assert plans and all("to_json" not in p.split("Exchange", 1)[1] and "StructsToJson" not in p.split("Exchange", 1)[1] for p in plans)


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = spark.read.text(str(tmp_path)).select(
            F.lit("a").alias("file"), F.lit(0).alias("split_pos"), F.monotonically_increasing_id().alias("line_key"), "value"
        )
        numbered = P._numbered(lines)
        assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.line_no for r in numbered.collect()) == [0, 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
