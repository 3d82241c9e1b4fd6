import base64
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import providers
from veilgauge.plans import cli, http


def made():
    """A provider the workers get by value."""

    def stub(prompts):
        import json

        out = []
        for p in prompts:
            text = p.split("Text:\n", 1)[1]
            out.append((None if "fail" in text else "no json" if "prose" in text else json.dumps({"attributes": [{"attribute": "gender", "inferred_value": "woman", "confidence": 0.9}]}), 5))
        return out

    return stub


def test_provider_and_fallback(spark):
    df = spark.createDataFrame([(1, "she is there", "x"), (2, "fail a@b.example", "x"), (3, "prose, she said so", "x"), (4, None, "x")], "id int, text string, category string")
    got = {r["id"]: r for r in providers.infer(df, made()).collect()}
    assert (got[1]["attacker_used"], got[1]["attributes"][0]["value"], got[1]["fallback_reason"], got[1]["tokens_used"]) == ("stub", "female", None, 5)
    assert got[2]["attacker_used"] == "rule_based" and got[2]["attributes"][0]["attribute"] == "email" and "no answer" in got[2]["fallback_reason"]
    assert got[3]["fallback_reason"].endswith("no list of attributes") and got[4]["attributes"] is None
    strict = {r["id"]: r for r in providers.infer(df, made(), strict=True).collect()}
    assert strict[1]["error"] is None and strict[1]["attributes"] and strict[2]["error"].startswith("strict: ") and strict[2]["attributes"] is None and strict[4]["error"] is None


def test_registry(spark):
    stub = made()
    providers.register("stub", stub, replace=True)
    assert providers.get("Stub") is stub and providers.get("Heuristic") is None and providers.PROVIDERS.has("LOCAL") and "anthropic" in providers.PROVIDERS.names()
    with pytest.raises(ValueError):
        providers.get("nobody")
    with pytest.raises(ValueError, match="already"):
        providers.register("stub", stub)
    assert providers.model_of("mock", None) == "heuristic-v1" and providers.model_of("local", "m") == "m"
    with pytest.raises(ValueError, match="model"):
        providers.get("openai")
    df = spark.createDataFrame([("she left",)], "text string")
    assert providers.infer(df, "rule_based").first()["attacker_used"] == "rule_based"
    assert df.select(providers.prompt(F.col("text")).alias("p")).first()["p"].endswith("Text:\nshe left")


class Service:
    """A stub of the three services, on a port of its own."""

    def __enter__(self):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        seen = self.seen = []
        said = json.dumps({"attributes": [{"attribute": "email", "inferred_value": "a@b.example", "confidence": 0.9, "evidence": "a@b.example", "category": "quasi"}]})

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                seen.append((self.path, dict(self.headers), body))
                out = {
                    "/openai": {"choices": [{"message": {"content": said}}], "usage": {"total_tokens": 7}},
                    "/anthropic": {"content": [{"type": "text", "text": said}], "usage": {"input_tokens": 3, "output_tokens": 4}},
                    "/ollama": {"response": said, "eval_count": 5, "prompt_eval_count": 2},
                }.get(self.path)
                data = json.dumps(out).encode() if out else b"broken"
                self.send_response(200 if out else 500)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        return self

    def __exit__(self, *args):
        self.server.shutdown()


def test_services(monkeypatch):
    """Each service is asked in its own form, and its answer and tokens are read; failures are null, a missing key an error."""
    with Service() as s:
        for kind in ("openai", "anthropic", "ollama"):
            ((raw, tokens),) = providers.HttpProvider(kind, "m1", f"{s.url}/{kind}")(["Text:\nhi"])
            assert json.loads(raw)["attributes"][0]["attribute"] == "email" and tokens == 7
        assert [b.get("temperature", b.get("options", {}).get("temperature")) for _, _, b in s.seen] == [0, 0, 0] and {b["model"] for _, _, b in s.seen} == {"m1"}
        assert {k.lower() for k in s.seen[1][1]} >= {"anthropic-version", "x-api-key"} and s.seen[1][2]["max_tokens"] and s.seen[2][2]["stream"] is False and s.seen[2][2]["prompt"].endswith("hi")
        assert providers.HttpProvider("openai", "m", f"{s.url}/none")(["a", "b"]) == [(None, 0), (None, 0)]
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        providers.HttpProvider("openai", "m")(["a"])


def test_scoring_with_a_provider(spark):
    from veilgauge.operators import population, score
    from veilgauge.schema import Settings

    providers.register("stub", made(), replace=True)
    df = spark.createDataFrame([(1, "she is there"), (2, "fail a@b.example"), (3, None)], "idx bigint, text string")
    cells = population.sample_for(spark, "US")
    got = {r["idx"]: r for r in score.score(df, cells, "idx", settings=Settings(attacker="stub")).collect()}
    assert got[1]["attacker_used"] == "stub" and got[1]["population"] == 32549 and got[2]["attacker_used"] == "rule_based" and got[2]["rating"] == "CRITICAL" and got[3]["score"] == 0
    strict = score.score(df, cells, "idx", settings=Settings(attacker="stub", strict=True))
    with pytest.raises(score.BatchError) as e:
        score.collected(strict, "idx")
    assert [r["idx"] for r in e.value.results] == [1, 3] and list(e.value.errors) == [2]
    with pytest.raises(ValueError, match="model"):
        score.score(df, cells, "idx", settings=Settings(attacker="ollama"))


def test_prompts_and_guesses(spark):
    from veilgauge.operators import benchmark

    assert all(a in providers.TEMPLATE for a in providers.V.CATEGORY) and providers.TEMPLATE.endswith("Text:\n")
    read = benchmark.read_guesses
    assert read('{"attributes": [{"attribute": "full_name", "inferred_value": "Zed"}, {"attribute": "name", "inferred_value": "Other"}]}') == {"name": "Zed"}
    assert read('[{"attribute": "gender", "inferred_value": "Male"}]') == {"gender": "Male"} and read('so: {"race": "White", "occupation": "unknown", "shoe": 3}') == {"race": "White"}
    assert read('```json\n{"guesses": {"nationality": {"value": "Born"}}}\n```') == {"citizenship_status": "Born"} and read("no") is None and read(None) is None and read("{broken") is None
    df = spark.createDataFrame([("medical", "implicit", ["gender", "race"], {"gender": "Male"})], "s string, d string, t array<string>, v map<string,string>")
    made_ = df.select(benchmark.generation_prompt(*[F.col(c) for c in "sdtv"]).alias("p")).first()["p"]
    assert "Patient:" in made_ and "- gender: Male" in made_ and "- race: unknown" in made_ and "Never state" in made_


def test_sqlite_sources(spark, tmp_path):
    import sqlite3

    from veilgauge.functions import vocabulary as V
    from veilgauge.sources import tables

    f = str(tmp_path / "p.db")
    with sqlite3.connect(f) as c:
        c.execute(f"CREATE TABLE people ({', '.join(V.BENCH_INDIRECT)}, more)")
        c.executemany(f"INSERT INTO people VALUES ({', '.join('?' * 10)})", [[f" v{i} "] * 9 + ["x"] for i in range(5)])
        c.execute(f"CREATE TABLE cross_tab (geography, {', '.join(V.POPULATION_COLUMNS)}, count)")
        c.executemany(f"INSERT INTO cross_tab VALUES ({', '.join('?' * 9)})", [["US", *["a"] * 7, i] for i in range(1, 6)])
    rows = tables.benchmark_sqlite(spark, f, "people")
    assert rows.columns == list(V.BENCH_INDIRECT) and {r["race"] for r in rows.collect()} == {f"v{i}" for i in range(5)}
    assert tables.population_sqlite(spark, f, "US", batch=2).agg(F.sum("count").alias("n")).first()["n"] == 15
    for bad in ("people; DROP TABLE x", "nothing"):
        with pytest.raises(ValueError):
            tables.benchmark_sqlite(spark, f, bad)
    assert {"csv", "sqlite", "records"} <= set(tables.BENCHMARK_SOURCES.names())


def test_cli(spark, tmp_path, capsys):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("Emma Stone, emma@post.example.org")
    b.write_text("Somebody came.")
    assert cli.main(["score", str(a), "--fail-above", "0.5"]) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["high_risk_count"] == 1
    assert cli.main(["compare", str(a), str(b)]) == 0
    assert json.loads(capsys.readouterr().out)["risk_reduction"] == 1.0
    assert cli.main(["score", str(a), "--geography", "FR"]) == 2 and cli.main(["scan", str(a), "--provider", "openai"]) == 2 and "model" in capsys.readouterr().err
    assert cli.main(["scan", str(a), "--text", "--confidence-threshold", "1"]) == 0 and "Record 1" in capsys.readouterr().out
    for bad in (["scan", str(a), "--fail-above", "1"], ["serve", "--port", "70000"], ["benchmark", "x", "--records", "0"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert cli.main(["score", str(a), "--report", "gdpr", "--format", "pdf", "--output", str(tmp_path / "r.pdf")]) == 0 and (tmp_path / "r.pdf").read_bytes().startswith(b"%PDF")
    (tmp_path / "p.csv").write_text("job,w\nnurse,2\n")
    assert cli.main(["build-db", str(tmp_path / "p.csv"), str(tmp_path / "pop"), "--geography", "GB", "--column", "occupation=job", "--weight", "w"]) == 0


def test_http(spark):
    server = http.serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body):
        url = f"http://127.0.0.1:{server.server_address[1]}{path}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert post("/score", {"text": "mail a@b.example"})[1]["rating"] == "CRITICAL"
    assert post("/batch", {"texts": ["mail a@b.example", "x"]})[1]["summary"]["total"] == 2
    assert post("/compare", {"original": "mail a@b.example", "anonymized": "x"})[1]["risk_reduction"] == 1.0
    assert post("/report", {"texts": ["x"], "standard": "ccpa"})[1]["standard"] == "ccpa"
    assert post("/v1/score/batch", {"texts": ["x"]})[1]["summary"]["total"] == 1 and "<html" in post("/v1/report", {"results": [{"text": "x"}], "format": "html"})[1]["report"]
    assert base64.b64decode(post("/v1/report", {"results": [{"text": "x"}], "format": "pdf"})[1]["report_base64"]).startswith(b"%PDF")
    assert post("/v1/report", {"results": [{"text": "x"}], "standard": "none"})[0] == 422 and post("/v1/score", [1])[0] == 400
    assert post("/score", {})[0] == 422 and post("/none", {})[0] == 404 and post("/score", {"text": "x" * (1 << 20)})[0] == 413
    server.shutdown()


def test_entry_and_registered_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (3, 4)} <= set(q)
