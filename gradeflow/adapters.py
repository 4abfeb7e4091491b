"""Adapters that ship with the engine: the test model, an external command, a long-lived line worker, and a model behind HTTP.

Each has load(), predict_batch(frame) -> frame and close(), see `operators.predictions.apply_adapter`; one instance lives as
long as its task. Items are rows (id, category, and what the command or model needs).
"""

from __future__ import annotations

import json
import os
import select
import shlex
import subprocess
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd

from .config import adapter
from .operators.predictions import LOOP, noisy_text


@adapter("dummy")
class Test:
    """oracle, empty, noisy, loop or fail: answers made from the truth."""

    def __init__(self, mode: str = "oracle", noise: float = 0.05, seed: int = 0) -> None:
        self.mode, self.noise, self.seed = mode, noise, seed

    def load(self) -> None:
        if self.mode not in ("oracle", "empty", "noisy", "loop", "fail"):
            raise ValueError(f"no such test mode: {self.mode}")

    def predict_batch(self, frame: pd.DataFrame) -> pd.DataFrame:
        if self.mode == "fail":
            raise RuntimeError("test failure")
        said = {"oracle": lambda r: r.gt, "empty": lambda r: "", "loop": lambda r: r.gt + LOOP, "noisy": lambda r: noisy_text(r.gt, r.id, self.noise, self.seed)}[self.mode]
        return pd.DataFrame({"id": frame["id"], "text": [said(r) for r in frame.itertuples()]})

    def close(self) -> None:
        pass


class _OneByOne:
    """Items one after another; an item that fails is a row with its error."""

    def load(self) -> None:
        pass

    def close(self) -> None:
        pass

    def predict_batch(self, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for item in frame.to_dict("records"):
            began = time.perf_counter()
            try:
                rows.append({"id": item["id"], "text": self.predict(item), "latency_s": time.perf_counter() - began})
            except Exception as why:  # noqa: BLE001 - any model error is data here
                rows.append({"id": item["id"], "error": f"{type(why).__name__}: {why}"})
        return pd.DataFrame(rows)


@adapter("command")
class Command(_OneByOne):
    """A command for each item, whose output is the answer; {id}, {category} and other columns are filled in."""

    def __init__(self, cmd: str, timeout: float = 600, cwd: str | None = None) -> None:
        self.parts, self.timeout, self.cwd = shlex.split(cmd), timeout, cwd

    def predict(self, item: dict) -> str:
        done = subprocess.run([p.format(**item) for p in self.parts], capture_output=True, text=True, timeout=self.timeout, cwd=self.cwd, check=False)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stderr.strip()[-500:]}")
        return done.stdout.strip()


@adapter("lines")
class LineWorker(_OneByOne):
    """One process a task: a JSON request a line, and a reply on a line that begins with `prefix`. It is started again after a timeout or its end."""

    def __init__(self, cmd: str, prefix: str = "RESULT ", timeout: float = 300) -> None:
        self.cmd, self.prefix, self.timeout, self.process = shlex.split(cmd), prefix, timeout, None

    def close(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            self.process = None

    def _lines(self) -> Iterator[str]:
        """Lines that the process writes, until its end or the timeout."""
        until, held = time.monotonic() + self.timeout, b""
        out = self.process.stdout.fileno()
        while (left := until - time.monotonic()) > 0 and select.select([out], [], [], left)[0]:
            data = os.read(out, 1 << 16)
            if not data:
                raise RuntimeError("the worker ended")
            *whole, held = (held + data).split(b"\n")
            yield from (line.decode() for line in whole)
        raise TimeoutError(f"no reply within {self.timeout} s")

    def predict(self, item: dict) -> str:
        if not self.process:
            self.process = subprocess.Popen(self.cmd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=0)
        try:
            self.process.stdin.write(json.dumps(item, default=str, ensure_ascii=False).encode() + b"\n")
            reply = json.loads(next(x for x in self._lines() if x.startswith(self.prefix))[len(self.prefix) :])
        except Exception:
            self.close()  # the next item gets a new one
            raise
        if reply.get("error"):
            raise RuntimeError(reply["error"])
        return reply.get("text", "")


@adapter("http")
class Http(_OneByOne):
    """A chat model behind HTTP: the item's prompt goes to {url}/chat/completions."""

    def __init__(self, url: str, model: str, prompt: str = "", key: str | None = None, timeout: float = 300) -> None:
        self.url, self.model, self.prompt, self.key, self.timeout = url.rstrip("/"), model, prompt, key, timeout

    def predict(self, item: dict) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": item.get("prompt") or self.prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"].strip()
