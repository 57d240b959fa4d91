"""A service that answers, refuses for a while, fails or lacks a key, and the settings that name it."""

import http.server
import json
import threading
import time

import pytest

from paperloom.sources import clients
from paperloom.sources.providers import Unavailable, ask


class Answers(http.server.BaseHTTPRequestHandler):
    """Model "busy" refuses twice for each prompt, "broken" always fails, "silent" says nothing, others repeat the prompt."""

    seen, under_way, most, lock = {}, 0, 0, threading.Lock()

    def do_POST(self):
        cls = type(self)
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with cls.lock:
            cls.under_way += 1
            cls.most = max(cls.most, cls.under_way)
            n = cls.seen[asked["model"], asked["prompt"]] = cls.seen.get((asked["model"], asked["prompt"]), 0) + 1
        time.sleep(0.05)
        code = 401 if self.headers["Authorization"] != "Bearer secret" else 500 if asked["model"] == "broken" else 429 if asked["model"] == "busy" and n < 3 else 200
        with cls.lock:
            cls.under_way -= 1
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0.01")
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"text": "" if asked["model"] == "silent" else f"{asked['model']}: {asked['prompt']}"}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Answers.seen, Answers.most = {}, 0
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_models_of_a_service_in_order(service):
    of = lambda *names, **more: clients.model_of(clients.Settings(service, names, "secret", timeout=5, **more), pause=0)
    assert of("broken", "silent", "good", tries=1).complete("hi") == "good: hi"
    assert of("busy").complete("hi") == "busy: hi" and Answers.seen["busy", "hi"] == 3
    with pytest.raises(Unavailable):
        of("broken", "silent", tries=2).complete("ho")
    assert Answers.seen["broken", "ho"] == 2 and Answers.seen["silent", "ho"] == 1
    with pytest.raises(Unavailable):
        clients.model_of(clients.Settings(service, ("good",), "wrong"), pause=0).complete("hi")


def test_missing_keys_and_names(monkeypatch, service):
    monkeypatch.delenv("PAPERLOOM_MODEL_KEY", raising=False)
    with pytest.raises(clients.MissingKey):
        clients.model_of(clients.Settings(service, ("good",)))
    with pytest.raises(clients.MissingKey):
        clients.model_of(clients.Settings("", ("good",), "secret"))
    with pytest.raises(Unavailable):
        clients.model_of(clients.Settings(service, (), "secret"))
    monkeypatch.setenv("PAPERLOOM_MODEL_KEY", "secret")
    assert clients.model_of(clients.Settings(service, ("good",))).complete("x") == "good: x"


def test_requests_at_a_time_are_bounded(service):
    model = clients.ServiceModel(clients.Settings(service, ("good",), "secret", concurrency=2), "good")
    threads = [threading.Thread(target=model.complete, args=(str(i),)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(Answers.seen) == 8 and Answers.most <= 2


def test_settings(spark):
    environ = {"PAPERLOOM_MODEL_URL": "http://a/", "PAPERLOOM_MODEL_NAMES": "x", "PAPERLOOM_MODEL_KEY": " k ", "PAPERLOOM_PIN_ADMIN": "1", "PAPERLOOM_PIN_CLERK": "2", "OTHER": "3"}
    spark.conf.set("spark.paperloom.model.names", "one, two,")
    spark.conf.set("spark.paperloom.pin.Admin", "9")
    spark.conf.set("spark.paperloom.model.concurrency", "7")
    try:
        s = clients.Settings.load(spark, environ)
    finally:
        for k in ("model.names", "pin.Admin", "model.concurrency"):
            spark.conf.unset(f"spark.paperloom.{k}")
    assert (s.url, s.models, s.key, s.concurrency, s.tries, dict(s.pins)) == ("http://a/", ("one", "two"), "k", 7, 3, {"admin": "9", "clerk": "2"})
    assert "k" not in repr(s).split("key")[0] and "'9'" not in repr(s) and clients.Settings.load(None, {}).models == ()


def test_workers_ask_the_service(spark, service):
    model = clients.model_of(clients.Settings(service, ("broken", "good"), "secret", tries=1), pause=0)
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(12)], "document_id string, prompt string").repartition(2)
    got = {r["document_id"]: r["raw"] for r in ask(prompts, model, at_once=3).collect()}
    assert got == {str(i): f"good: p{i}" for i in range(12)} and Answers.most <= 6

    class Fails:
        def complete(self, prompt):
            if prompt == "p3":
                raise KeyError("anything")
            return prompt

    got = {r["document_id"]: r["raw"] for r in ask(prompts, Fails()).collect()}
    assert got["3"] is None and got["4"] == "p4"
