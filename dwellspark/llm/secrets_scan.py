"""Operator 6: secret scans.

An Aho-Corasick automaton finds keywords in one pass; only where one stands is a regular expression tried, anchored
there. Kinds with a checksum inside are kept only if it holds. Runs of hexadecimal digits have no keyword: those of
the shortest length that counts are searched directly.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch, texts

#: In the order in which kinds are listed at one start.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]

# Keywords and patterns of the base kinds, and of tokens whose issuers published a format.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,})")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: What all parts of such a token are made of: where one start in a run fails, so do all others in it.
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_checksum(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as such tokens end."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _token(m: re.Match) -> bool:
    body = m[0].partition("_")[2]
    return base62_checksum(body[:-6]) == body[-6:]


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        return isinstance(head, dict) and "alg" in head
    except (ValueError, RecursionError):
        return False


def _pem(m: re.Match) -> bool:
    try:
        return base64.b64decode("".join(m[2].split()), validate=True)[:1] == b"0"  # a DER sequence
    except (ValueError, binascii.Error):
        return False


#: By kind: keywords in lower case, the anchored expression, and what a match must pass.
RULES = {
    "assign": (ASSIGN_WORDS, ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, _token),
    "npm": (("npm_",), NPM, _token),
    "jwt": (("eyj",), JWT, _jwt),
    "pem": (("-----begin ",), PEM, _pem),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (words, _, _) in RULES.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_AUTOMATON = None
_UPPER = {c: c + 32 for c in range(65, 91)}


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive. Matches of one kind don't
    overlap; the leftmost is taken whether or not it passes its test, so one inside a failing match is none."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    low = text.lower()
    if len(low) != len(text):  # some letters get longer in lower case
        low = text.translate(_UPPER)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _AUTOMATON.iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, at in starts.items():
        _, expression, holds = RULES[kind]
        after = 0
        for s in sorted(at):
            if s < after:
                continue
            if m := expression.match(text, s):
                after = m.end()
                if holds(m):
                    spans.append((kind, s, after))
            elif kind == "jwt":
                after = JWT_RUN.match(text, s).end()
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))



def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends (arrays of one length) for each row, repeated rows and null ids included; a null or empty
    text has none. Other columns are not read."""
    rows = texts(docs, id_col, text_col)

    def run(batch: pa.RecordBatch):
        found = [scan(t) if t else [] for t in batch.column(1).to_pylist()]
        lists = [pa.array([[x[i] for x in spans] for spans in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "kinds", "starts", "ends"])

    return by_batch(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<long>, ends array<long>")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counted = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    spans = F.zip_with("kinds", F.arrays_zip("starts", "ends"), lambda k, x: F.concat_ws(":", k, x["starts"].cast("string"), x["ends"].cast("string")))
    base = F.filter(spans, lambda x: F.substring_index(x, ":", 1).isin(*BASE))
    return found.select("doc_id", *(counted(k) for k in BASE), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))
