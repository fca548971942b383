"""A stand-in for a model: a local server of chat requests."""

import http.server
import json
import threading
import time


class Model:
    """A server of chat requests that counts, is busy now and then, and gives a bad answer to one text."""

    def __init__(self, bad="none"):
        self.times, self.bodies, outer = [], [], self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.times.append(time.monotonic())
                outer.bodies.append((body, self.headers["Authorization"]))
                text = body["messages"][-1]["content"]
                busy = len(outer.times) % 7 == 3
                words = {"words": 1} if bad in text else {"words": [{"lemma": w.strip("."), "word_type": "noun", "article": None} for w in text.split()]}
                said = json.dumps({"choices": [{"message": {"content": json.dumps(words)}}]}).encode()
                self.send_response(429 if busy else 200)
                self.send_header("Retry-After", "0")
                self.end_headers()
                self.wfile.write(b"slow down" if busy else said)

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1/chat/completions"
