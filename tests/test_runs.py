"""Reading, settings, and whole runs over a small folder of documents."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import providers
from corvane.plans import config as settings
from corvane.plans import pipelines
from corvane.sources import npy, readers, sinks
from corvane.streaming import ingest


@pytest.fixture()
def project(tmp_path):
    data = tmp_path / "2001_01 data"
    data.mkdir()
    (data / "bulletin_2012_06.txt").write_text("# June Report\nDebt outstanding was 500 million.\n")
    (data / "2022_06.txt").write_text("# Summer\nReceipts were 120 million.\n\nOutlays were 90 million.")
    (data / "deep").mkdir()
    (data / "deep" / "2022_09.txt").write_bytes(b"# Fall\nReceipts were 130 million \xff.\n")
    (data / "2022_10.md").write_text("ignored")
    (tmp_path / "key.csv").write_text('uid,question,answer,source_files\nU1,"What were receipts, in\nJune 2022?",120,2022_06.txt\nU2,Debt in 06/2012?,500,2012_06\nU3,Receipts in 2022?,130,\n')
    raw = {
        "data_dir": str(data), "csv_path": str(tmp_path / "key.csv"), "selected_years": [2012, 2022], "vector_db_type": "parquet", "chunk_size": 20, "chunk_overlap": 2, "top_k": 2,
        "index_dir": str(tmp_path / "index"), "embedding": {"backend": "keyword", "words": ["receipts", "debt", "outlays", "june"]},
        "generation": {"backend": "extractive", "request_sleep_seconds": 0, "retry_sleep_seconds": 0},
        "runs": {m: {"output_dir": str(tmp_path / m), "metadata_enabled": m != "baseline"} for m in ("baseline", "engineered", "question_filter")},
    }
    return tmp_path, raw


def test_documents(spark, project):
    _, raw = project
    rows = readers.documents(spark, raw["data_dir"], [2022]).orderBy("doc_pos").collect()
    assert [(r.year, r.month) for r in rows] == [(2022, 6), (2022, 9)]
    assert "�" in rows[1].text and rows[0].source_path.endswith("2001_01 data/2022_06.txt")


def test_documents_that_cannot_be_used(spark, project):
    _, raw = project
    with pytest.raises(readers.DataError, match="no files of the years"):
        readers.documents(spark, raw["data_dir"], [1999])
    path = f"{raw['data_dir']}/undated.txt"
    open(path, "w").write("x")
    with pytest.raises(readers.DataError, match="no year and month"):
        readers.documents(spark, raw["data_dir"], [2022])
    open(path.replace("undated", "2022_11"), "w").write(" \n")
    __import__("os").remove(path)
    with pytest.raises(Exception, match="blank text file"):
        readers.documents(spark, raw["data_dir"], [2022]).collect()


def test_questions(spark, project):
    _, raw = project
    key = readers.answer_key(spark, raw["csv_path"])
    rows = readers.questions(key).orderBy("_row").collect()
    assert [(r.question_id, r.row_year, r.row_month, [tuple(p) for p in r.source_date_pairs]) for r in rows] == [("U1", 2022, 6, [(2022, 6)]), ("U2", 2012, 6, [(2012, 6)]), ("U3", 2022, None, [])]
    with pytest.raises(readers.DataError):
        readers.questions_of_years(key, [1980])
    assert readers.find_column([" Answer ", "QUERY", "query"], readers.QUESTION_COLUMNS) == "query"
    with pytest.raises(readers.DataError):
        readers.questions(key.drop("answer"))


def test_chunks_that_cannot_be_used(spark, tmp_path):
    for i, line in enumerate(["{no", '{"text": "a"}', '{"text": "a", "metadata": {"chunk_id": "c"}}']):
        path = tmp_path / f"{i}.jsonl"
        path.write_text(line + "\n")
        with pytest.raises(Exception, match="not JSON|incomplete chunk"):
            readers.chunks(spark, str(path)).collect()


def test_logs(spark, tmp_path):
    assert readers.retrieval_logs(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"question_id": "a", "detected_year": 1}\n\n{"question_id": "a", "detected_year": 2}\n{"detected_year": 3}\n')
    assert [(r.question_id, r.detected_year) for r in readers.retrieval_logs(spark, str(tmp_path / "l.jsonl")).collect()] == [("a", 2)]


def test_lines_in_the_order_of_files(spark, tmp_path):
    """Spark reads larger files first; a name and a line decide all the same, in files of one split and of many."""
    d = tmp_path / "logs.jsonl"
    d.mkdir()
    rows = lambda lo, hi, pad: "".join(json.dumps({"question_id": f"q{i % 5}", "detected_year": i, "model_config": "x" * pad}) + "\n" * (1 + i % 2) for i in range(lo, hi))
    (d / "part-0.json").write_text(rows(0, 20, 1))
    (d / "part-1.json").write_text(rows(20, 400, 300))
    (d / "part-2.json").write_text(rows(400, 460, 1) + " \n")
    (d / "part-3.json").write_text("")
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {(x.question_id, x.detected_year) for x in readers.retrieval_logs(spark, str(d)).collect()} == {(f"q{i}", 455 + i) for i in range(5)}
            got = readers.json_lines(spark, str(d), readers.LOG_SCHEMA).orderBy("_pos").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [x.detected_year for x in got] == list(range(460))
        at = {x.detected_year: (x._file[-6:], x._line) for x in got}
        assert at[0] == ("0.json", 1) and at[1] == ("0.json", 2) and at[2] == ("0.json", 4) and at[20] == ("1.json", 1) and at[401] == ("2.json", 2)
        assert [x._pos for x in got][:4] == [0, 1, 3, 4]
    (d / "part-1.json").write_text(rows(20, 23, 3) + "{nonsense\n" + rows(23, 30, 3))
    with pytest.raises(Exception, match=r"part-1\.json, line 5: not JSON as expected: \{nonsense"):
        readers.retrieval_logs(spark, str(d)).collect()


def test_vectors_and_env(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(2))
    assert [list(r.vector) for r in readers.vectors(spark, str(tmp_path / "v.npy")).orderBy("pos").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    (tmp_path / ".env").write_text("# c\nA = 'x'\nB=2\nbad\n")
    assert readers.env_file(str(tmp_path / ".env"), {"B": "1"}) == {"A": "x", "B": "1"}
    assert readers.env_file(str(tmp_path / "no"), {"B": "1"}) == {"B": "1"}


def test_matrices_by_ranges_of_bytes(spark, tmp_path, monkeypatch):
    m = np.arange(600, dtype=">i2").reshape(120, 5)
    monkeypatch.setattr(npy, "RANGE_BYTES", 100)
    monkeypatch.setattr(npy, "BATCH_BYTES", 25)
    np.save(tmp_path / "v.npy", m)
    np.savez(tmp_path / "stored.npz", format=npy.INDEX_TAG, vectors=m.astype("<f8"))
    np.savez_compressed(tmp_path / "packed.npz", format=npy.INDEX_TAG, vectors=m.astype("<f4"))
    for name, parts in (("v.npy", 12), ("stored.npz", 60), ("packed.npz", 1)):
        reader = npy.NpyReader(str(tmp_path / name))
        ranges = reader.partitions()
        assert len(ranges) == parts
        got = [x for p in ranges for b in reader.read(p) for x in zip(b.column("pos").to_pylist(), b.column("vector").to_pylist())]
        assert got == list(enumerate(m.astype(float).tolist()))
        assert [list(r.vector) for r in readers.vectors(spark, f"file://{tmp_path / name}").orderBy("pos").collect()] == m.tolist()
    np.savez(tmp_path / "other.npz", format="something else", vectors=m)
    np.savez(tmp_path / "none.npz", vectors=m)
    np.save(tmp_path / "flat.npy", np.arange(3))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.eye(3)))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    (tmp_path / "no.npy").write_text("no")
    (tmp_path / "torn.npy").write_bytes((tmp_path / "v.npy").read_bytes()[:-1])
    for bad in ("other.npz", "none.npz", "flat.npy", "columns.npy", "no.npy", "torn.npy"):
        with pytest.raises(Exception, match="something else|lacks|no matrix|magic|ends before"):
            readers.vectors(spark, str(tmp_path / bad)).collect()
    with pytest.raises(Exception, match="share"):
        readers.vectors(spark, "s3a://bucket/v.npy").collect()
    assert readers.vectors(spark, str(tmp_path / "empty.npy")).collect() == []
    df = spark.createDataFrame([(i, [float(i), -i / 2]) for i in range(50)], "i long, vector array<double>").repartitionByRange(3, "i").sortWithinPartitions("i")
    npy.write(df, str(tmp_path / "out.npy"))
    assert [tuple(r.vector) for r in readers.vectors(spark, str(tmp_path / "out.npy")).orderBy("pos").collect()] == [(float(i), -i / 2) for i in range(50)]
    assert np.load(sorted((tmp_path / "out.npy").glob("*.npy"))[0]).dtype == np.float32
    with pytest.raises(Exception, match="several lengths"):
        npy.write(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").coalesce(1), str(tmp_path / "bad.npy"))


def test_settings(project):
    _, raw = project
    c = settings.run(raw, "baseline")
    assert c["document_years"] == [2012, 2022] and c["metadata_enabled"] is False and c["generation"]["backend"] == "extractive"
    for bad in ({"chunk_overlap": 20}, {"top_k": 0}, {"selected_years": []}, {"vector_db_type": "x"}, {"embedding": {"backend": "x"}}, {"generation": {"backend": "remote", "max_tokens": 0}}, {"runs": {"baseline": {"output_dir": "x", "chunk_size": 5}}}, {"runs": {}}):
        with pytest.raises(settings.ConfigError):
            settings.run(raw | bad, "baseline")
    with pytest.raises(settings.ConfigError):
        settings.shared({k: v for k, v in raw.items() if k != "data_dir"})
    with pytest.raises(settings.ConfigError):
        settings.run(raw, "other")
    small = settings.evaluation({"csv_path": "k.csv", "output_dir": "o"}, "baseline", "/b")
    assert small["index_dir"] == "/b/o"


@pytest.mark.parametrize("mode", ["baseline", "engineered", "question_filter"])
def test_runs(spark, project, mode):
    tmp, raw = project
    c = settings.run(raw, mode)
    answers = {r.question_id: r for r in pipelines.run_qa(spark, c).collect()}
    m = json.loads((tmp / "index" / "manifest.json").read_text())
    assert list(m)[:-1] == sinks.MANIFEST_KEYS and m["chunk_count"] == 3 and m["document_count"] == 3 and m["embedding_dim"] == 4
    assert pipelines.index_matches(spark, c) and not pipelines.index_matches(spark, c | {"chunk_size": 19})
    if mode == "engineered":
        assert answers["U1"].final_context_ids == ["2022_06_00000"] and answers["U2"].predicted_answer.startswith("June Report Debt outstanding was 500 million. [S1]")
        assert len(answers["U3"].final_context_ids) == 2
    said = [(r.question, json.dumps({"supported_claims": 1, "total_claims": 2, "fabricated_claims": 1, "correct_answer": "yes"})) for r in answers.values()]
    judge = providers.RecordedJudge(spark.createDataFrame(said, "question string, verdict string"))
    got = pipelines.run_evaluation(spark, c, judge)
    here = Path(pipelines.evaluation_folder(spark, c["output_dir"]).removeprefix("file://"))
    assert got["groundedness"] == 0.5 and got["factual_accuracy"] == 1.0 and got["hallucination_rate"] == 0.5
    assert json.loads((here / "metrics.json").read_text()) == got and readers.csv(spark, str(here / "evaluation_details.csv")).count() == 3
    if mode == "engineered":
        assert got["hit_rate@5"] == 1.0 and got["mrr"] == 1.0
    done = readers.predictions(spark, str(tmp / mode / "predictions.csv"))
    assert done.count() == 3 and sinks.without_done(done, done.limit(1)).count() == 2


def test_remote_backend(spark, project):
    _, raw = project
    c = settings.run(raw | {"generation": {"backend": "remote", "allow_extractive_fallback": True, "max_retries": 0, "request_sleep_seconds": 0}}, "engineered")

    def call(messages):
        if "Debt in" in messages[1]["content"].split("# Question")[1]:
            raise ConnectionError("down")
        return "About 120 [S1]"

    got = {r.question_id: r.predicted_answer for r in pipelines.run_qa(spark, c, call=call).collect()}
    assert got["U1"] == "About 120 [S1]" and got["U2"].endswith("[S1]") and "500" in got["U2"]


class Service(BaseHTTPRequestHandler):
    """Embeds by length, answers with a citation, judges; refuses its first call."""

    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.calls.append((self.path, self.headers["Authorization"], body))
        if len(self.calls) == 1:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if self.path == "/v1/embeddings":
            out = {"data": [{"index": i, "embedding": [len(x), 1.0]} for i, x in enumerate(body["input"])][::-1]}
        elif "response_format" in body:
            out = {"choices": [{"message": {"content": None, "reasoning_content": '{"supported_claims": 1, "total_claims": 1, "correct_answer": true}'}}]}
        else:
            out = {"choices": [{"message": {"content": "Said [S1]"}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *_):
        pass


def test_remote_service(spark, project, monkeypatch):
    """Embedding, answering and judging over HTTP, with nothing but settings."""
    tmp, raw = project
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote = {"backend": "remote", "base_url": f"http://127.0.0.1:{server.server_port}/v1", "api_key_env": "MY_KEY", "request_sleep_seconds": 0, "retry_sleep_seconds": 0}
    c = settings.run(raw | {"embedding": remote | {"model_name": "e", "batch_size": 2}, "generation": remote | {"model": "g", "temperature": 0.5, "num_ctx": 99}}, "engineered")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="MY_KEY"):
        pipelines.run_qa(spark, c)
    monkeypatch.setenv("MY_KEY", "k")
    got = pipelines.run_qa(spark, c).collect()
    assert {r.predicted_answer for r in got} == {"Said [S1]"} and len(got) == 3
    found = pipelines.run_evaluation(spark, c)
    assert found["groundedness"] == 1.0 and found["factual_accuracy"] == 1.0
    paths = {p for p, _, _ in Service.calls}
    assert paths == {"/v1/embeddings", "/v1/chat/completions"} and {a for _, a, _ in Service.calls} == {"Bearer k"}
    assert all(len(b["input"]) <= 2 and b["model"] == "e" for p, _, b in Service.calls if p == "/v1/embeddings")
    asked = [b for p, _, b in Service.calls if p == "/v1/chat/completions" and "response_format" not in b]
    assert all(b["model"] == "g" and b["temperature"] == 0.5 and b["num_ctx"] == 99 and b["max_tokens"] == 512 for b in asked)
    server.shutdown()


def test_resume_asks_only_what_is_left(spark, project):
    tmp, raw = project
    c = settings.run(raw | {"generation": {"backend": "remote", "request_sleep_seconds": 0}}, "engineered")
    log = tmp / "asked"

    def call(messages):
        with open(log, "a") as f:
            f.write("x")
        return "Yes [S1]"

    asked = lambda: len(log.read_text()) if log.exists() else 0
    assert pipelines.run_qa(spark, c, call=call).count() == 3 and asked() == 3
    assert pipelines.run_qa(spark, c, call=call, resume=True).count() == 3 and asked() == 3
    # As if one had never been asked: its question has changed since.
    key = tmp / "key.csv"
    key.write_text(key.read_text().replace("Debt in 06/2012?", "What was the debt in 06/2012?"))
    again = pipelines.run_qa(spark, c, call=call, resume=True)
    assert again.count() == 3 and asked() == 4 and {r.question_no for r in again.collect()} == {0, 1, 2}


def test_a_run_that_fails_keeps_its_slices(spark, project):
    tmp, raw = project
    g = {"backend": "remote", "request_sleep_seconds": 0, "retry_sleep_seconds": 0, "max_retries": 1, "slice_questions": 1}
    c = settings.run(raw | {"generation": g}, "engineered")
    log, down = tmp / "asked", tmp / "down"
    down.write_text("")

    def call(messages):
        if "Debt" in messages[-1]["content"].split("Question", 1)[-1] and down.exists():
            raise ConnectionError("down")
        with open(log, "a") as f:
            f.write("x")
        return "Yes [S1]"

    with pytest.raises(Exception, match="the answer provider failed"):
        pipelines.run_qa(spark, c, call=call)
    assert len(log.read_text()) == 1
    path = f"{c['output_dir']}/answers-{pipelines.run_hash(c)}"
    assert len(sinks.committed(spark, path)) == 1
    # A slice that was being written when the run was killed isn't taken for done.
    torn = tmp / "engineered" / Path(path).name / "after-0" / "slice-9"
    torn.mkdir(parents=True)
    (torn / "part-00000.parquet").write_bytes(b"PAR1")
    down.unlink()
    rest = pipelines.run_qa(spark, c, call=call, resume=True)
    assert {r.question_no for r in rest.collect()} == {0, 1, 2} and len(log.read_text()) == 3
    assert readers.predictions(spark, f"{c['output_dir']}/predictions.csv").count() == 3


def test_a_task_that_fails_repeats_no_request(spark, tmp_path):
    """Replies are kept one by one; what was torn off while it was written is asked again."""
    log, down, journal = tmp_path / "asked", tmp_path / "down", str(tmp_path / "journal")
    down.write_text("")

    def call(messages):
        if messages[0]["content"] == "prompt 7" and down.exists():
            raise SystemExit  # the worker is gone
        with open(log, "a") as f:
            f.write(messages[0]["content"] + "\n")
        return messages[0]["content"].upper()

    rows = spark.createDataFrame([(i, [("user", f"prompt {i % 15}")]) for i in range(30)], "i long, messages array<struct<role:string,content:string>>")
    ask = lambda: providers.generate(rows, call, in_flight=3, journal=journal)
    with pytest.raises(Exception):  # noqa: B017
        ask().collect()
    files = sorted(Path(journal).iterdir())
    assert files
    with open(files[0], "a") as f:
        f.write('\n["abc", "to')
    down.unlink()
    got = {r.i: r.raw_answer for r in ask().collect()}
    assert got == {i: f"PROMPT {i % 15}" for i in range(30)}
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(f"prompt {i}" for i in range(15))


def test_calls_in_flight_and_their_rate(spark, tmp_path):
    log = tmp_path / "times"

    def call(messages):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return "x"

    rows = spark.range(12).select(F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    asked = providers.generate(rows, call, before=0.2, in_flight=2)
    assert asked.rdd.getNumPartitions() == 2 and asked.count() == 12
    asked.collect()
    times = sorted(map(float, log.read_text().split()))
    assert len(times) == 12 and times[-1] - times[0] >= 0.2 * 12 / 2


def test_index_that_does_not_agree(spark, project):
    tmp, raw = project
    c = settings.run(raw, "baseline")
    pipelines.build_index(spark, c)
    pipelines.check_index(spark, c["index_dir"])
    path, said = tmp / "index" / "manifest.json", json.loads((tmp / "index" / "manifest.json").read_text())
    for change, error in (({"index_backend": "x"}, "kind"), ({"chunk_count": 9}, "manifest says 9"), ({"embedding_dim": 5}, "manifest says 5")):
        path.write_text(json.dumps(said | change))
        (path.parent / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(readers.DataError, match=error):
            pipelines.check_index(spark, c["index_dir"])


def test_questions_that_cannot_be_searched(spark, project):
    _, raw = project
    c = settings.run(raw, "baseline")
    pipelines.build_index(spark, c)
    index, provider = pipelines.load_index(spark, c["index_dir"]), pipelines.embedder(c)
    plans = lambda q: spark.createDataFrame([(0, q, None, None, [])], "query_id long, question string, year int, month int, date_pairs array<struct<year:int,month:int>>")
    assert pipelines.search(plans("receipts"), index, c, provider, None).count() == 2 == pipelines.search(plans("receipts"), index, c, provider, 0).count()
    assert pipelines.search(plans("receipts"), index, c, provider, 1).count() == 1
    with pytest.raises(ValueError, match="negative"):
        pipelines.search(plans("x"), index, c, provider, -1)
    with pytest.raises(Exception, match="must not be empty"):
        pipelines.search(plans(" \t"), index, c, provider).collect()


def test_documents_without_chunks(spark, project):
    docs = spark.createDataFrame([("p", 0, 2020, 1, "a b"), ("q", 1, 2020, 1, " \n ")], "source_path string, doc_pos long, year int, month int, text string")
    with pytest.raises(Exception, match="no chunks in document q"):
        pipelines.chunk_table(docs, {"chunk_size": 5, "chunk_overlap": 0}).collect()


def test_a_judge_that_fails_is_told_of(spark, project):
    tmp, raw = project
    c = settings.run(raw | {"generation": {"backend": "extractive", "max_retries": 1, "retry_sleep_seconds": 0, "request_sleep_seconds": 0}}, "baseline")
    pipelines.run_qa(spark, c)
    error = tmp / "baseline" / "judge_error.json"
    with pytest.raises(Exception, match="can't be read: nothing"):
        pipelines.run_evaluation(spark, c, lambda prompt: "nothing")
    assert "nothing" in json.loads(error.read_text())["error"]
    with pytest.raises(readers.DataError, match="no evaluation"):
        pipelines.evaluation_folder(spark, c["output_dir"])
    pipelines.run_evaluation(spark, c, lambda prompt: {"output_text": "{}"})
    assert not error.exists()
    with pytest.raises(ValueError, match="recorded verdicts"):
        pipelines.run_evaluation(spark, c)


def test_an_evaluation_that_fails_leaves_the_earlier_one_whole(spark, project, monkeypatch):
    tmp, raw = project
    c = settings.run(raw, "baseline")
    pipelines.run_qa(spark, c)
    judge = lambda n: lambda prompt: {"output_text": json.dumps({"total_claims": n})}
    first = pipelines.run_evaluation(spark, c, judge(1))
    before = pipelines.evaluation_folder(spark, c["output_dir"])

    def fail(*a, **k):
        raise OSError("disk full")

    for step in ("write_one", "keep_only"):
        with monkeypatch.context() as m:
            m.setattr(sinks, step, fail)
            with pytest.raises(OSError, match="disk full"):
                pipelines.run_evaluation(spark, c, judge(2))
        here = Path(pipelines.evaluation_folder(spark, c["output_dir"]).removeprefix("file://"))
        assert (str(here) == before) == (step == "write_one") and json.loads((here / "metrics.json").read_text()) == first
        assert {r.total_claims for r in readers.csv(spark, str(here / "evaluation_details.csv")).collect()} == ({"1"} if step == "write_one" else {"2"})
    sinks.keep_only(spark, str(here.parent), [here.name])
    assert [x.name for x in (tmp / "baseline" / "evaluations").iterdir()] == [here.name]


def test_rows_are_numbered_in_order(spark, tmp_path, monkeypatch):
    """Over ranges of a sorted column, and over the files of a table of rows."""
    monkeypatch.setattr(readers, "RANGE_ROWS", 7)
    values = [f"v{i * 7919 % 100:03d}" for i in range(100)] + ["v005"]
    got = readers.sorted_numbers(spark.createDataFrame([(v,) for v in values], "v string"), "v", "n").collect()
    assert {r.v: r.n for r in got} == {v: i for i, v in enumerate(sorted(set(values)))}
    (tmp_path / "t").mkdir()
    for k, rows in (("a", [0, 1, 2]), ("b", [3]), ("c", [4, 5])):
        (tmp_path / "t" / f"{k}.csv").write_text("x\n" + "".join(f'"{i}\n"\n' for i in rows))
    assert {r.x.strip(): r._row for r in readers.csv(spark, str(tmp_path / "t")).collect()} == {str(i): i for i in range(6)}


def test_other_years_are_not_read(spark, project):
    """The filter on paths reaches the listing: a blank file of another year isn't opened."""
    _, raw = project
    d = readers.documents(spark, raw["data_dir"], [2012])
    assert "PartitionFilters" in (plan := d._jdf.queryExecution().executedPlan().toString()) or "DataFilters" in plan
    read = spark.read.option("recursiveFileLookup", True).text(raw["data_dir"], wholetext=True).filter("_metadata.file_path LIKE '%2012_06%'")
    assert read.count() == 1 and d.count() == 1


def test_stream(spark, project):
    """An index that grows by what arrives: places in order of arrival, changed files replaced, a batch run twice the same."""
    tmp, raw = project
    data, c = tmp / "2001_01 data", settings.run(raw | {"index_dir": str(tmp / "streamed"), "document_years": [2012, 2022, 2023]}, "engineered")

    def run():
        ingest.run(spark, c, str(tmp / "checkpoint")).awaitTermination()
        rows = pipelines.check_index(spark, c["index_dir"]).select("pos", "text", "metadata.source_path").collect()
        said = pipelines.read_manifest(spark, c["index_dir"])
        assert said["chunk_count"] == len(rows) and said["document_count"] == len({r.source_path for r in rows})
        return {(r.pos, r.source_path.rsplit("/", 1)[1], r.text.split()[-1]) for r in rows}

    first = {(0, "2022_06.txt", "million."), (10_000_000, "bulletin_2012_06.txt", "million."), (20_000_000, "2022_09.txt", "\ufffd.")}
    assert {(p, n) for p, n, _ in run()} == {(p, n) for p, n, _ in first}
    (data / "2023_01.txt").write_text("RECEIPTS\nmore")
    (data / "2021_01.txt").write_text("of another year")
    (data / "2022_07.txt").write_text(" \n")
    assert (30_000_000, "2023_01.txt", "more") in run()
    # Files whose names have been seen aren't read again; one is new.
    (data / "2022_06.txt").write_text("# Summer\nReceipts were 120 million.\n\nOutlays were 90 million.")
    (data / "2023_01.txt").write_text("RECEIPTS\nless")
    (data / "2022_12.txt").write_text("Debt was 7")
    got = run()
    assert {x for x in got if x[0] >= 30_000_000} == {(30_000_000, "2023_01.txt", "more"), (40_000_000, "2022_12.txt", "7")} and len(got) == 5
    assert pipelines.index_matches(spark, c)
    # Documents that come again: one as it was, one changed, one new. A batch that is tried again leaves the same rows.
    docs = spark.createDataFrame([(str(data / "2023_01.txt"), 2023, 1, "RECEIPTS even less"), (str(data / "2023_02.txt"), 2023, 2, "June 5"), (str(data / "2022_12.txt"), 2022, 12, "Debt was 7")], "source_path string, year int, month int, text string")
    for _ in range(2):
        ingest.merge_batch(docs, 900, c, pipelines.embedder(c))
    got = run()
    assert {x for x in got if x[0] >= 30_000_000} == {(30_000_000, "2023_01.txt", "less"), (40_000_000, "2022_12.txt", "7"), (50_000_000, "2023_02.txt", "5")} and len(got) == 6
    answers = pipelines.run_qa(spark, c)
    assert answers.count() == 3 and "120" in answers.filter("question_no = 0").first().predicted_answer
    pipelines.finish_index(spark, c, pipelines.embedder(c))
    assert readers.chunks(spark, f"{c['index_dir']}/chunks.jsonl").count() == 6


def test_a_stream_needs_an_index_of_its_own(spark, project):
    _, raw = project
    c = settings.run(raw, "engineered")
    pipelines.build_index(spark, c)
    docs = spark.createDataFrame([("x", 2023, 1, "a b")], "source_path string, year int, month int, text string")
    with pytest.raises(readers.DataError, match="index of|one of their own"):
        ingest.merge_batch(docs, 0, c, pipelines.embedder(c))


def test_files_are_as_many_as_their_size_asks_for(spark, monkeypatch):
    """What the queries on predictions and evaluations write isn't bound to one or three tasks."""
    from corvane.plans import round_trips
    from corvane.sources import sinks as written

    class Seen(Exception):
        pass

    def chunks(rows, path):
        raise Seen(rows.rdd.getNumPartitions())

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(round_trips.prediction_file(spark, "/root/testdata/sf0.01").inputFiles()) > 1
        monkeypatch.setattr(written, "write_chunks", chunks)
        with pytest.raises(Seen, match=spark.conf.get("spark.sql.shuffle.partitions")):
            round_trips.evaluate_details(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_embedders_get_bounded_calls(spark):
    from corvane import providers as p

    class Few(p.HashEmbedder):
        def encode(self, texts):
            assert len(texts) <= 1024
            return super().encode(texts)

    rows = p.embed(spark.range(5000).coalesce(1).selectExpr("id", "cast(id as string) AS text"), Few(8))
    assert rows.count() == 5000 and rows.filter("size(vector) = 8").count() == 5000


def test_the_index_is_searched_once_for_all_slices(spark, monkeypatch):
    from corvane.plans import pipelines as runs
    from corvane.plans import round_trips
    from corvane.sources.scratch import scratch

    root, sf, calls, search = scratch(spark, "once"), "/root/testdata/sf0.001", [], runs.search
    round_trips._write_documents(spark, sf, root)
    round_trips._write_key(spark, sf, root)
    monkeypatch.setattr(runs, "search", lambda *a: calls.append(1) or search(*a))
    answers = runs.run_qa(spark, round_trips._config(root, generation={"backend": "extractive", "slice_questions": 7}))
    assert answers.count() > 7 and len(calls) == 1


def test_a_streamed_file_is_chunked_in_pieces(spark, project, monkeypatch):
    """Files cut in splits of some bytes: the same chunks as of the whole texts, whatever lies at the cuts."""
    import random

    from corvane.operators import long_documents

    tmp, raw = project
    r, data = random.Random(5), tmp / "odd"
    kinds = ["# Head {0}", "TOTAL RECEIPTS", "", " \t", "words of line {0} and more", "a  1  2  {0}", "b  4  5  6", "end\r", "x\r\r", "one\rtwo", "\x0bq  1  2  3\x0cr  1  2  3", "café   {0}", "\uffffmark\ufffe", "Table {0}"]
    data.mkdir()
    for month in range(1, 7):
        text = "\n".join(r.choice(kinds).format(i) for i in range(r.choice([1, 40, 90]))) + r.choice(["", "\n", "\r\n"]) + ("\nlast" if month % 2 else " last\n\n")
        (data / f"2022_0{month}.txt").write_bytes((b"\xef\xbb\xbf" if month % 2 else b"") + text.encode() + (b"\xe2\x82 bad" if month == 2 else b""))
    (data / "2022_07.txt").write_bytes(b" \r\n\n")
    more = raw | {"data_dir": str(data), "document_years": [2022], "chunk_size": 9, "chunk_overlap": 2}
    c, whole = (settings.run(more | {"index_dir": str(tmp / name)}, "engineered") for name in ("in-pieces", "whole"))
    seen, chunk = [], long_documents.chunk_pieces
    monkeypatch.setattr(long_documents, "chunk_pieces", lambda marked, *a: seen.append(marked.count()) or chunk(marked, *a))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        ingest.run(spark, c, str(tmp / "odd-checkpoint")).awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    (data / "2022_07.txt").unlink()
    pipelines.build_index(spark, whole)
    rows = [sorted(tuple(x) for x in pipelines.check_index(spark, x["index_dir"]).select("pos", "text", "metadata", "vector").collect()) for x in (c, whole)]
    assert rows[0] == rows[1] and len(rows[0]) > 50 and seen[0] > 12
    # Digests don't depend on the cuts: the same documents as whole texts change nothing.
    was = sorted(ingest.register(spark, c["index_dir"]).select("source_path", "batch").collect())
    # But for bytes that aren't UTF-8, which whole texts lose when they are split, and byte-order marks.
    docs = spark.read.text(str(data), wholetext=True).filter(~F.col("value").startswith("\ufeff") & ~F.col("value").endswith("bad"))
    known = ingest.register(spark, c["index_dir"]).select("source_path", "year", "month")
    again = docs.select(readers.decode_path(F.col("_metadata.file_path")).alias("source_path"), F.col("value").alias("text")).join(known, "source_path")
    assert again.count() == 2
    ingest.merge_batch(again, 7, c, pipelines.embedder(c))
    assert sorted(ingest.register(spark, c["index_dir"]).select("source_path", "batch").collect()) == was


def test_index_runs_chunk_files_in_pieces(spark, project, monkeypatch):
    """An index run reads a file by its splits, and its chunks are those of whole texts, also of files that have no line."""
    tmp, raw = project
    data = tmp / "long"
    data.mkdir()
    lines = ["# Head {0}", "TOTAL RECEIPTS", "", "words of line {0} and more", "a  1  2  {0}", "b  4  5  6", "end\r"]
    for month in (1, 2):
        (data / f"2022_0{month}.txt").write_bytes("\n".join(lines[(i * month) % 7].format(i) for i in range(80)).encode())
    (data / "2022_03.txt").write_bytes(b"\xef\xbb\xbf")
    (data / "2022_04.txt").write_bytes(b"x\n")
    c = settings.run(raw | {"data_dir": str(data), "document_years": [2022], "chunk_size": 9, "chunk_overlap": 2, "index_dir": str(tmp / "long-index")}, "baseline")
    held, join = [], pipelines.piece_table
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def back(pieces, docs, config, path):
        for k, v in keep.items():
            spark.conf.set(k, v)
        held.append(pieces.groupBy("source_path").count().agg(F.max("count")).first()[0])
        return join(pieces, docs, config, path)

    monkeypatch.setattr(pipelines, "piece_table", back)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pipelines.build_index(spark, c)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    whole = pipelines.chunk_table(readers.documents(spark, str(data), [2022]), c)
    rows = [sorted(tuple(x) for x in df.select("pos", "text", "metadata").collect()) for df in (pipelines.check_index(spark, c["index_dir"]), whole)]
    assert rows[0] == rows[1] and len(rows[0]) > 30 and held[0] > 5
    (data / "2022_05.txt").write_bytes(b" \n\n")
    with pytest.raises(Exception, match="blank text file.*2022_05"):
        pipelines.build_index(spark, c)
