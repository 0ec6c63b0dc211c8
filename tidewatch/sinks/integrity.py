"""Signed manifests of files, atomic writes with a mirror, encrypted chained logs."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def sign(entries: dict[str, str], key: bytes) -> str:
    body = json.dumps(entries, sort_keys=True).encode()
    return hmac.new(key, body, hashlib.sha256).hexdigest()


def write_manifest(paths: list[str], target: str, key: bytes) -> None:
    """SHA-256 of each file and an HMAC over all of them."""
    entries = {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}
    atomic_write(target, json.dumps({"entries": entries, "signature": sign(entries, key)}))


def verify_manifest(target: str, folder: str, key: bytes) -> list[str]:
    """Names of files that are missing or changed; a bad signature is an error."""
    found = json.loads(Path(target).read_text())
    if not hmac.compare_digest(found["signature"], sign(found["entries"], key)):
        raise ValueError("the manifest was changed")
    bad = []
    for name, digest in found["entries"].items():
        p = Path(folder, name)
        if not p.exists() or hashlib.sha256(p.read_bytes()).hexdigest() != digest:
            bad.append(name)
    return bad


def atomic_write(path: str, text: str) -> None:
    """Replace a file in one step and keep what it was as ``.bak``."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if target.exists():
        os.replace(target, f"{target}.bak")
    os.replace(name, target)


def safe_load(path: str) -> dict:
    """A JSON file, or its mirror if it is missing or broken."""
    for p in (path, f"{path}.bak"):
        try:
            return json.loads(Path(p).read_text())
        except (OSError, ValueError):
            continue
    raise FileNotFoundError(path)


def inside(path: str, root: str) -> Path:
    """The resolved path, which must lie below ``root``."""
    p = Path(root, path).resolve()
    if not p.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside of {root}")
    return p


def encrypted(lines: DataFrame, column: str, key_hex: str) -> DataFrame:
    """A text column encrypted by AES-GCM, base64: a key of 16, 24 or 32 bytes in hexadecimal."""
    return lines.withColumn(column, F.base64(F.aes_encrypt(F.col(column), F.unhex(F.lit(key_hex)), F.lit("GCM"))))


def decrypted(lines: DataFrame, column: str, key_hex: str) -> DataFrame:
    return lines.withColumn(column, F.aes_decrypt(F.unbase64(F.col(column)), F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string"))


class ChainedLog:
    """An append-only log file whose lines carry an HMAC over the line before: a cut, swap or edit breaks the chain."""

    def __init__(self, path: str, key: bytes):
        self.path, self.key = Path(path), key
        self.last = "genesis"
        if self.path.exists():
            for entry in self.read():
                self.last = entry["mac"]

    def _mac(self, before: str, body: str) -> str:
        return hmac.new(self.key, f"{before}\n{body}".encode(), hashlib.sha256).hexdigest()

    def append(self, record: dict) -> None:
        body = json.dumps(record, sort_keys=True)
        mac = self._mac(self.last, body)
        with self.path.open("a") as f:
            f.write(json.dumps({"body": body, "mac": mac}) + "\n")
        self.last = mac

    def read(self) -> list[dict]:
        """All entries; a broken chain is an error."""
        before, out = "genesis", []
        for line in self.path.read_text().splitlines():
            entry = json.loads(line)
            if not hmac.compare_digest(entry["mac"], self._mac(before, entry["body"])):
                raise ValueError("the chain is broken")
            out.append(entry)
            before = entry["mac"]
        return out


def new_key() -> str:
    return secrets.token_hex(32)
