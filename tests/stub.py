"""A scripted judgment service: counts requests and peak concurrency."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Stub:
    def __init__(self, scenario="ok"):
        self.scenario, self.lock, self.elsewhere = scenario, threading.Lock(), ""
        self.reset()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with stub.lock:
                    stub.requests += 1
                    stub.now += 1
                    stub.peak = max(stub.peak, stub.now)
                    stub.auth = self.headers["Authorization"]
                    stub.bodies.append(body)
                try:
                    status, out = stub.answer(body)
                finally:
                    with stub.lock:
                        stub.now -= 1
                if stub.scenario == "redirect":
                    self.send_response(302)
                    self.send_header("Location", stub.elsewhere)
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                data = out if isinstance(out, bytes) else json.dumps(out).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                if stub.scenario == "truncated":
                    self.send_header("x-local-jev-truncated", "true")
                self.end_headers()
                self.wfile.write(data)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1"

    def reset(self):
        self.requests, self.now, self.peak, self.auth, self.bodies = 0, 0, 0, None, []

    def answer(self, body):
        s = self.scenario
        if s == "unauthorized":
            return 401, {"secret": "leak"}
        if s == "error":
            return 500, b"x" * 5000
        if s == "huge":
            return 200, b"x" * (2 << 20)
        if s == "slow":
            time.sleep(0.05)
        if s == "stuck":
            time.sleep(3)
        answers = {}
        rows = body["state"]["rows"]
        for i, (key, q) in reversed(list(enumerate(body["questions"].items()))):
            if q["type"] == "noul":
                value = {"out-of-range": 1.5, "negative": -0.1, "wrong-type": "0.5"}.get(s, float(rows[i]) if s == "echo" else 0.83)
                answers[key] = {"type": "noul", "noul": value}
            else:
                value = "foreign" if s == "unknown-label" else rows[i] if s == "echo" and rows[i] in q["criteria"] else sorted(q["criteria"])[0]
                answers[key] = {"type": "choice", "choice": value}
        if s == "missing":
            answers = {}
        if s == "extra":
            answers["zz"] = {"type": "noul", "noul": 0.5}
        return 200, {"model": "jev-2.0" if s == "drift" else body["model"] if body["model"] != "jev-latest" else "jev-1.13.0", "usage": {"input_tokens": 10, "output_tokens": 1}, "answers": answers}

    def close(self):
        self.server.shutdown()
        self.server.server_close()
