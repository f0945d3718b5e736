"""Process metrics, helper processes, and small sample files."""

from __future__ import annotations

import os
import socket
import struct
import subprocess
import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from msgflow.functions.display import PID_STATUS

PROCESS = "pid bigint, status string, cpu_seconds double, ram_bytes bigint"


def one_character(text: str) -> str:
    """A setting that has to be one character; raises ``ValueError``."""
    if len(text) != 1:
        raise ValueError(f"one character is wanted, not {text!r}")
    return text


def process_row(pid: int) -> tuple[int, str, float, int]:
    """``pid, status, cpu_seconds, ram_bytes`` of a process of this machine; a process that isn't there is UNKNOWN."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            rest = f.read().rpartition(")")[2].split()
    except OSError:
        return pid, "UNKNOWN", 0.0, 0
    status = next((name for name, spellings in PID_STATUS.items() if rest[0] in spellings), "UNKNOWN")
    return pid, status, (int(rest[11]) + int(rest[12])) / os.sysconf("SC_CLK_TCK"), int(rest[21]) * os.sysconf("SC_PAGE_SIZE")


def processes(spark: SparkSession, pids: list[int]) -> DataFrame:
    """Metrics of processes of the driver's machine."""
    return spark.createDataFrame([process_row(p) for p in pids], PROCESS)


class Helper:
    """A helper process: started, waited for until it is ready, and ended if it isn't; use it in a ``with``."""

    def __init__(self, command: list[str], ready: Callable[[], bool], within_s: float = 30.0):
        self.process = subprocess.Popen(command)
        self.pid = self.process.pid
        end = time.monotonic() + within_s
        while not ready():
            if self.process.poll() is not None or time.monotonic() > end:
                self.stop()
                raise RuntimeError(f"{command[0]} was not ready in time")
            time.sleep(0.05)

    def stop(self) -> None:
        if self.process.poll() is None:
            self.process.terminate()
            try:
                self.process.wait(5)
            except subprocess.TimeoutExpired:
                self.process.kill()
                self.process.wait()

    def __enter__(self) -> Helper:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


def port_open(port: int, host: str = "127.0.0.1") -> Callable[[], bool]:
    """A test whether something listens at a port."""

    def test() -> bool:
        with socket.socket() as s:
            s.settimeout(0.2)
            return s.connect_ex((host, port)) == 0

    return test


def sample_pdf(pages: list[list[str]], title: str = "Sample", author: str = "Nobody") -> bytes:
    """A PDF with lines of text on its pages."""
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    bodies = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>", f"<</Title({title})/Author({author})>>"]
    out: list[bytes] = [b.encode("cp1252") for b in bodies]
    for k, lines in enumerate(pages):
        shown = "\n".join(f"({line.translate({40: chr(92) + '(', 41: chr(92) + ')', 92: chr(92) * 2})}) Tj T*" for line in lines)
        stream = zlib.compress(f"BT /F1 12 Tf 14 TL 72 720 Td\n{shown}\nET".encode("cp1252"))
        out += [f"<</Type/Page/Parent 2 0 R/Contents {5 + 2 * k} 0 R>>".encode(), f"<</Length {len(stream)}/Filter/FlateDecode>>\nstream\n".encode() + stream + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + body + b"\nendobj\n" for n, body in enumerate(out, 1)) + b"trailer<</Root 1 0 R/Info 3 0 R>>\n%%EOF"


def sample_png(width: int = 800, height: int = 600) -> bytes:
    """A grey PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress((b"\0" + b"\x80" * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def sample_aiff(frames: int = 100) -> bytes:
    """A silent AIFF of one channel."""
    common = struct.pack(">hIh", 1, frames, 16) + bytes.fromhex("400eac44000000000000")
    sound = struct.pack(">II", 0, 0) + bytes(2 * frames)
    body = b"AIFF" + b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">I", len(sound)) + sound
    return b"FORM" + struct.pack(">I", len(body)) + body
