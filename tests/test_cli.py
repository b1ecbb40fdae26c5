import json
import random

from caselens import cli


def test_commands(spark, tmp_path, capsys):
    rows = [{"qid": f"q{i}", "condition": c, "correct": ok, "correct_boxed": ok, "predicted_boxed": "A", "gold": "A", "body_system": "S"} for i in range(20) for c, ok in (("no-rag", i % 2 == 0), ("use_vision-on", i % 3 == 0))]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    questions = [{"id": f"q{i}", "options": {"A": "renal cyst" if i < 5 else "unseen thing"}, "label": "A", "body_system": "S", "images": ["x/a.png"]} for i in range(20)]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, questions)))
    cases = spark.createDataFrame([("u1", 0, "p0", "Renal cyst", None), ("u1", 1, None, "Renal cyst", None), ("u2", 0, "p2", "stone", "stone")], "u_id string, image_idx int, image_path string, title string, case_diagnosis string")
    for f in ("differential_diagnosis", "modality", "plane", "location", "age", "sex", "history", "exam", "findings", "disease_discussion"):
        cases = cases.selectExpr("*", f"CAST(NULL AS string) AS {f}")
    cases.coalesce(1).write.parquet(str(tmp_path / "cases"))
    at = lambda x: str(tmp_path / x)
    cli.main(["summary", "--results", at("r.jsonl"), "--output", at("s.json")])
    assert json.loads((tmp_path / "s.json").read_text())["by_condition"]["no-rag"]["correct"] == 10
    cli.main(["mcnemar", "--results", at("r.jsonl")])
    cli.main(["coverage", "--results", at("r.jsonl"), "--questions", at("q.jsonl"), "--cases", at("cases")])
    assert "substring" in capsys.readouterr().out
    cli.main(["questions", "--input", at("q.jsonl"), "--output", at("sample"), "--n", "7", "--images-dir", "/img"])
    got = [json.loads(x) for p in sorted((tmp_path / "sample").glob("*.json")) for x in p.read_text().splitlines()]
    assert [g["id"] for g in got] == [f"q{i}" for i in random.Random(42).sample(range(20), 7)] and got[0]["image_paths"] == ["/img/a.png"]
    cli.main(["corpus", "--cases", at("cases"), "--output", at("corpus")])
    assert {r.pdf_path: r.text for r in spark.read.parquet(at("corpus/case_text")).collect()}["u1"] == "Diagnosis: Renal cyst"
    cli.main(["index", "--cases", at("cases"), "--text", at("corpus/case_text"), "--output", at("index")])
    assert spark.read.parquet(at("index/documents")).count() == 2


def write_questions(path, n=6):
    rows = [{"id": f"q{i}", "question": f"what is renal thing {i}? (B) this", "options": {"A": "renal cyst", "B": "stone"}, "label": "AB"[i % 2], "body_system": "S", "images": [f"x/{i}.png"], "image_paths": [f"{path.parent}/img/{i}.png"]} for i in range(n)]
    path.write_text("\n".join(map(json.dumps, rows)))


def write_corpus(spark, tmp_path):
    cases = spark.createDataFrame([("u1", 0, f"{tmp_path}/img/0.png"), ("u1", 1, f"{tmp_path}/img/gone.png"), ("u2", 0, f"{tmp_path}/img/1.png")], "u_id string, image_idx int, image_path string")
    cases.coalesce(1).write.parquet(str(tmp_path / "cases"))
    spark.createDataFrame([("u1", 0, "a renal cyst thing"), ("u2", 0, "a stone of the bladder"), ("u3", 0, " ")], "pdf_path string, page_number int, text string").coalesce(1).write.parquet(str(tmp_path / "text"))


def hashed():
    from caselens.operators.embedding import hashed_words

    return hashed_words(32)()


def test_a_run_from_index_to_paired_tests(spark, tmp_path, capsys):
    write_questions(tmp_path / "q.jsonl")
    write_corpus(spark, tmp_path)
    at = lambda x: str(tmp_path / x)
    cli.main(["run", "--cases", at("cases"), "--text", at("text"), "--questions", at("q.jsonl"), "--output", at("out"), "--model", "caselens.operators.evaluation:first_option", "--embedder", "tests.test_cli:hashed"])
    said = capsys.readouterr().out
    assert "== discordant pairs" in said and "no-rag" in said
    summary = json.loads((tmp_path / "out/summary.json").read_text())
    assert summary["n_questions"] == 6 and {c: (x["total"], x["correct"]) for c, x in summary["by_condition"].items()} == dict.fromkeys(["no-rag", "use_vision-off", "use_vision-on"], (6, 3))
    rows = [json.loads(x) for p in sorted((tmp_path / "out/results").glob("*.json")) for x in p.read_text().splitlines()]
    assert len(rows) == 18 and all(len(r) == 22 for r in rows)
    on = next(r for r in rows if r["qid"] == "q0" and r["condition"] == "use_vision-on")
    assert on["predicted"] == "B" and on["sources"][0]["u_id"] == "u1" and on["sources"][0]["n_attached_images"] == 2 and on["n_question_images"] == 1 and on["ctx_chars"] > 0
    off = next(r for r in rows if r["qid"] == "q0" and r["condition"] == "no-rag")
    assert off["ctx_chars"] == 0 and off["n_retrieved_images"] == 0 and off["sources"] == on["sources"]


def test_image_audit_reads_only_what_it_compares(spark, tmp_path, capsys):
    write_questions(tmp_path / "q.jsonl")
    write_corpus(spark, tmp_path)
    (tmp_path / "img").mkdir()
    for i in range(40):
        (tmp_path / f"img/{i}.png").write_bytes(b"broken" if i == 1 else bytes([i // 2]))
    rows = [{"qid": "q0", "condition": "use_vision-on", "correct_official": True, "sources": [{"u_id": "u1", "rank": 1}]}, {"qid": "q1", "condition": "use_vision-on", "correct_official": False, "sources": [{"u_id": "u2", "rank": 1}]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))

    def decode(content, sizes):
        if content == b"broken":
            raise ValueError
        return [[float(x) for x in range(w * h)] for w, h in sizes]

    from argparse import Namespace

    at = lambda x: str(tmp_path / x)
    cli.phash(spark, Namespace(results=at("r.jsonl"), questions=at("q.jsonl"), cases=at("cases"), condition="use_vision-on", top_k=3, ahash_thresh=10, dhash_thresh=10), decode)
    said = capsys.readouterr().out
    assert "3 images needed, 2 skipped" in said and "ValueError" in said and "FileNotFoundError" in said and "likely" in said


def test_snapshot_of_a_dataset(spark, tmp_path):
    from caselens.sources import hub

    (tmp_path / "data").mkdir()
    for name in ("test-00000-of-00002", "test-00001-of-00002", "dev"):
        (tmp_path / f"data/{name}.jsonl").write_text(json.dumps({"id": name, "question": "x"}))
    assert list(hub.splits(spark, str(tmp_path))) == ["test", "dev"]
    got = hub.read_split(spark, str(tmp_path), "id string, question string", "test")
    assert [r.id for r in got.orderBy("_pos").collect()] == ["test-00000-of-00002", "test-00001-of-00002"]
    rows = spark.createDataFrame([("7", bytearray(b"one"), "A"), ("7", None, "A"), ("7", bytearray(b"three"), "A"), (None, bytearray(b"x"), "B")], "u_id string, image binary, title string")
    for f in ("case_diagnosis", "differential_diagnosis", "modality", "plane", "location", "age", "sex", "history", "exam", "findings", "disease_discussion"):
        rows = rows.selectExpr("*", f"CAST(NULL AS string) AS {f}")
    (tmp_path / "cases").mkdir()
    rows.coalesce(1).toPandas().to_parquet(tmp_path / "cases/train-00000-of-00001.parquet")
    cli.main(["corpus", "--cases", str(tmp_path / "cases"), "--split", "train", "--output", str(tmp_path / "out"), "--images-dir", str(tmp_path / "img"), "--convert", ""])
    assert (tmp_path / "img/7_00.png").read_bytes() == b"one" and (tmp_path / "img/7_02.png").read_bytes() == b"three"
    assert sorted((r.u_id, r.image_idx, r.uid_n_images) for r in spark.read.parquet(str(tmp_path / "out/cases")).where("u_id is not null").collect()) == [("7", 0, 2), ("7", 2, 2)]
