"""HTTP voices and refiners against a small server of our own."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from lectern.operators import engines, services
from lectern.sources.audio import wav_bytes


@pytest.fixture
def server():
    seen, failures = [], [503]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, code, body=b""):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.answer(200)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if failures and self.path != "/chat/completions":
                self.answer(failures.pop())
            elif self.path == "/chat/completions":
                self.answer(200, json.dumps({"choices": [{"message": {"content": '[{"index": 1, "emotion": "sad", "intensity": 0.5}]'}}]}).encode())
            else:
                self.answer(200, wav_bytes(np.zeros(2205, np.float32), 22_050))

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", seen, failures
    own.shutdown()


def test_tagged_voice(server, tmp_path, monkeypatch):
    url, seen, failures = server
    monkeypatch.setattr(services, "linear_delay", lambda k: 0.0)
    (tmp_path / "v.wav").write_bytes(b"voice")
    engine = services.TaggedApi(url, str(tmp_path / "v.wav"), "words")
    engine.initialize()
    assert len(engine.synthesize("Hi.", "sad", 0.7, 1.0)) == 4410
    assert len(seen) == 2 and seen[1] == ("/v1/tts", {"text": "[very sad, melancholic] Hi.", "format": "wav", "reference_audio": "dm9pY2U=", "reference_text": "words"})
    failures.append(400)
    with pytest.raises(services.Refused):
        engine.synthesize("Hi.", "neutral", 0.3, 1.0)
    assert len(seen) == 3
    with pytest.raises(RuntimeError, match="cannot reach"):
        services.TaggedApi("http://127.0.0.1:9").initialize()


def test_speech_api(server, monkeypatch):
    url, seen, _ = server
    monkeypatch.setattr(services, "doubling_delay", lambda k: 0.0)
    assert len(services.SpeechApi(url).synthesize("Hi.", "sad", 0.7, 1.0)) == 2400
    assert seen[-1][0] == "/audio/speech" and seen[-1][1]["input"] == "Hi."
    assert isinstance(engines.get_engine("speech_api"), services.SpeechApi)


def test_refiner(server):
    url, seen, _ = server
    client = services.chat_client(url, "m")()
    assert json.loads(client('{"sentences": [{"index": 1, "text": "t"}]}'))[0]["emotion"] == "sad"
    assert seen[-1][1]["messages"][1]["content"] == '[{"index": 1, "text": "t"}]'
