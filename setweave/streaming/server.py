"""Serves a reactor: updates by HTTP, observations by WebSocket.

``POST /update`` evaluates its body with the root as ``$`` and replaces it; the answer is the new root. On ``GET /observe`` as a WebSocket, each text that
comes in is an expression to observe in place of the one before; its values go out as wire JSON, the first at once. An error ends the observation.
"""

from __future__ import annotations

import base64
import hashlib
import http.server
import json
import struct
import threading
from typing import Any

from setweave.lang import values as V
from setweave.operators.relation import Rel
from setweave.sources import formats
from setweave.streaming.observe import Reactor

# A fixed value of the protocol.
MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, CLOSE, PING, PONG = 1, 8, 9, 10
#: Bytes of a message that a client may send.
MOST = 1 << 20


def wire(x: Any) -> str:
    """A value as wire JSON; a relation as the set of its rows, one after the other from the executors."""
    if isinstance(x, Rel):
        x = frozenset(V.Tup({k: V.value(v) for k, v in r.asDict().items()}) for r in x.df.toLocalIterator())
    return formats.to_wire(x)


def frame(kind: int, data: bytes) -> bytes:
    """An unmasked frame, as servers send them."""
    size = len(data)
    head = bytes([size]) if size < 126 else b"\x7e" + struct.pack(">H", size) if size < 1 << 16 else b"\x7f" + struct.pack(">Q", size)
    return bytes([0x80 | kind]) + head + data


def message(read) -> tuple[int, bytes]:
    """Kind and content of a client's next message, of one frame or several; a connection that ends is one that closes."""
    kind, data = None, b""
    while True:
        head = read(2)
        if len(head) < 2:
            return CLOSE, b""
        size = head[1] & 127
        size = size if size < 126 else struct.unpack(">H" if size == 126 else ">Q", read(2 if size == 126 else 8))[0]
        if size + len(data) > MOST or not head[1] & 128:
            return CLOSE, b""
        mask = read(4)
        part = bytes(c ^ mask[i % 4] for i, c in enumerate(read(size)))
        if head[0] & 15 >= CLOSE:
            return head[0] & 15, part
        kind, data = kind or head[0] & 15, data + part
        if head[0] & 128:
            return kind, data


class Server(http.server.ThreadingHTTPServer):
    """A server of one reactor; evaluations are one at a time."""

    daemon_threads = True

    def __init__(self, reactor: Reactor, host: str = "127.0.0.1", port: int = 0):
        super().__init__((host, port), _Handler)
        self.reactor, self.lock = reactor, threading.RLock()


class _Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    server: Server

    def log_message(self, *_: Any) -> None:
        pass

    def answer(self, status: int, body: str) -> None:
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self) -> None:
        text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
        if self.path != "/update":
            return self.answer(404, json.dumps("no such path"))
        try:
            with self.server.lock:
                self.answer(200, wire(self.server.reactor.update(text)))
        except ValueError as error:
            self.answer(400, json.dumps(str(error)))

    def do_GET(self) -> None:
        key = self.headers.get("Sec-WebSocket-Key")
        if self.path != "/observe" or not key or self.headers.get("Upgrade", "").lower() != "websocket":
            return self.answer(404, json.dumps("no such path"))
        self.send_response(101)
        for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", base64.b64encode(hashlib.sha1((key + MAGIC).encode()).digest()).decode())):
            self.send_header(name, value)
        self.end_headers()
        self.close_connection = True
        self.watch()

    def watch(self) -> None:
        stop = None
        try:
            while True:
                kind, data = message(self.rfile.read)
                if kind == PING:
                    self.wfile.write(frame(PONG, data))
                elif kind == TEXT:
                    with self.server.lock:
                        if stop:
                            stop()
                        stop = self.server.reactor.observe(data.decode(), lambda x: self.wfile.write(frame(TEXT, wire(x).encode())), self.fail)
                else:
                    return
        except OSError:
            return
        finally:
            if stop:
                stop()

    def fail(self, error: Exception) -> None:
        try:
            self.wfile.write(frame(TEXT, json.dumps({"error": str(error)}).encode()) + frame(CLOSE, struct.pack(">H", 1000)))
        except OSError:
            pass
