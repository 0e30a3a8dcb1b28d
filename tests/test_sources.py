import json

import pytest

from strataloom.sources import files, pages
from strataloom.streaming import replay


def put(folder, question, numbers, end=True, size=3):
    base = folder / question
    base.mkdir(parents=True, exist_ok=True)
    for k in numbers:
        data = [{"id": str(100 * k + j), "author": {"name": f"n{j}"}, "content": "c", "voteup_count": j} for j in range(size)]
        (base / f"page-{k}.json").write_text(json.dumps({"data": data, "paging": {"is_end": end and k == max(numbers)}}))


def test_batch_pages(spark, tmp_path):
    put(tmp_path, "11", range(12))
    put(tmp_path, "12", range(1))
    pages.register(spark)
    df = spark.read.format("replay_pages").option("path", str(tmp_path)).load()
    rows = df.orderBy("question_id", "page").collect()
    assert [(r.question_id, r.page, r.offset) for r in rows][:3] == [("11", 0, 0), ("11", 1, 3), ("11", 2, 6)]
    assert replay.capture_events(df).where("done").count() == 2


@pytest.mark.parametrize("content,message", [({"data": [], "paging": {}}, "empty"), ({"data": {}}, "no list")])
def test_broken_pages(tmp_path, content, message):
    put(tmp_path, "11", [0], end=False)
    (tmp_path / "11" / "page-1.json").write_text(json.dumps(content))
    with pytest.raises(pages.PagingError, match=message):
        list(pages.read_pages(str(tmp_path), "11"))


def test_repeated_page_and_cap(tmp_path):
    put(tmp_path, "11", [0], end=False)
    (tmp_path / "11" / "page-1.json").write_text((tmp_path / "11" / "page-0.json").read_text())
    with pytest.raises(pages.PagingError, match="repeats"):
        list(pages.read_pages(str(tmp_path), "11"))
    put(tmp_path, "12", range(5), end=False)
    with pytest.raises(pages.PagingError, match="more than"):
        list(pages.read_pages(str(tmp_path), "12", cap=3))


def test_empty_last_page_is_an_end(tmp_path):
    put(tmp_path, "11", [0], end=False)
    (tmp_path / "11" / "page-1.json").write_text(json.dumps({"data": [], "paging": {"is_end": True}}))
    assert [r[3] for r in pages.read_pages(str(tmp_path), "11")] == [False, True]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    put(source, "11", range(2), end=False)
    replay.ingest(spark, str(source), table, state).awaitTermination(120)
    first = replay.read_table(spark, table).count()
    # a known id comes again with other values, and a new page appears
    (source / "11" / "page-2.json").write_text(json.dumps({"data": [{"id": "0", "voteup_count": 99}, {"id": "900"}], "paging": {"is_end": True}}))
    replay.ingest(spark, str(source), table, state).awaitTermination(120)
    rows = {r.id: r.voteupcount for r in replay.read_table(spark, table).collect()}
    assert first == 6 and len(rows) == 7 and rows["0"] == 0
    replay.ingest(spark, str(source), table, state).awaitTermination(120)
    assert replay.read_table(spark, table).count() == 7


def test_question_documents_in_two_shapes(spark, tmp_path):
    for name, text in (("7", '{"questionId":"7",\n"questionTitle":"t",\n"answers":[{"id":"1","voteupCount":3},{"id":"2"}]}'), ("8", '[{"id":"5","content":"x"}]'), ("9", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "answers.json").write_text(text)
    docs = files.question_documents(spark, [str(tmp_path), str(tmp_path / "none")], skip_corrupt=True)
    by = {r.question_id: r for r in docs.collect()}
    assert by["8"].bare_array and not by["7"].bare_array and by["9"].corrupt and by["7"].title == "t"
    rows = {(r.questionid, r.id, r.captureseq, r.voteupcount) for r in files.answers_of(docs).collect()}
    assert rows == {("7", "1", 0, 3), ("7", "2", 1, None), ("8", "5", 0, None)}
    with pytest.raises(Exception, match="corrupt document"):
        files.question_documents(spark, [str(tmp_path)]).collect()
    assert files.question_documents(spark, [str(tmp_path / "none")]).count() == 0


def test_map_files_keep_corrupt_rows(spark, tmp_path):
    (tmp_path / "map-a.json").write_text('{"chunkId":"a","summary":"s"}')
    (tmp_path / "map-b.json").write_text("{oops")
    (tmp_path / "chunk-a.json").write_text('{"chunkId":"a","sourceIds":["x"]}')
    (tmp_path / "chunk-b.json").write_text("{oops")
    got = {r.file: r.corrupt for r in files.map_files(spark, str(tmp_path)).collect()}
    assert got == {"map-a.json": False, "map-b.json": True}
    assert [r.chunkId for r in files.chunk_files(spark, str(tmp_path)).collect()] == ["a"]


def test_driver_files(tmp_path, spark):
    state = files.Progress(str(tmp_path))
    assert state.load() == (0, False)
    state.save(40, True)
    assert state.load() == (40, True)
    (tmp_path / ".progress.json").write_text("{")
    with pytest.raises(files.CorruptFile):
        state.load()
    assert list(tmp_path.glob(".progress.json.corrupt-*")) and state.load() == (0, False)
    (tmp_path / "list.txt").write_text("# c\n\n 123 \nhttps://qa.example/question/45?x=1\nabc\n")
    assert [r.question_id for r in files.batch_inputs(spark, str(tmp_path / "list.txt")).collect()] == ["123", "45", None]
    (tmp_path / "empty.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        files.batch_inputs(spark, str(tmp_path / "empty.txt"))
    assert files.relative(str(tmp_path / "a" / "b"), str(tmp_path)) == "a/b"
