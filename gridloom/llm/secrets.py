"""Secret scans: base patterns, and a token-efficiency test for random strings.

Base spans are whole matches of three patterns, leftmost and non-overlapping per kind, kept if long enough. The test
adds spans of kind token: strings of STRING letters, digits and +/_-= whose characters per token under a tiktoken
vocabulary are below MAX_CHARS_PER_TOKEN, for prose and code words have few tokens and random strings many. Known
digests (hexadecimal of a digest's length), UUIDs, numbers, and identifiers and paths made of words are excluded; their
words are joined by _, -, / or a change of case and are themselves encoded in few tokens, so an unbroken run of letters
is always tested, however long. Base spans stay whatever the test says.

Cases: null text is empty; positions are code points, end exclusive; a repeated row is scanned as often as it occurs; an
empty table gives an empty result; in redacted() all columns stay, text and n_chars (if there) are those after redaction.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, small_batches, table

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hexadecimal letters of 16 and more: the same spans as of all runs, the short ones dropped.
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 12, 18
STRING = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MAX_CHARS_PER_TOKEN = 2.2
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
SEPARATORS = re.compile(r"[-_/=]+")
#: A word of an identifier, each with a short number at its end, and a field of such words joined by changes of case.
WORD = re.compile(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z]))[0-9]{0,3}")
FIELD = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++(?![a-z])|[A-Z]+(?=[A-Z][a-z]))[0-9]{0,3}+(?:(?:[A-Z][a-z]++|[A-Z]++(?![a-z])|[A-Z]+(?=[A-Z][a-z]))[0-9]{0,3}+)*+")
#: Letters that a word next to a change of case has at least.
CASE_WORD = 3
KINDS = ("assign", "access", "hex", "token")
MASK = "[SECRET]"


def encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def identifier(s: str, tokens) -> bool:
    """Whether s is several words, joined by separators or changes of case, that the vocabulary has few tokens for."""
    words: list[str] = []
    for field in filter(None, SEPARATORS.split(s)):
        if not FIELD.fullmatch(field):
            return False
        own = WORD.findall(field)
        if len(own) > 1 and min(map(len, own)) < CASE_WORD:
            return False
        words += own
    return len(words) > 1 and sum(map(len, words)) >= MAX_CHARS_PER_TOKEN * sum(len(tokens.encode_ordinary(w)) for w in words)


def excluded(s: str, tokens) -> bool:
    return bool(len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s) or UUID.fullmatch(s) or NUMBER.fullmatch(s) or len(set(s)) < 8 or sum(map(str.isupper, s)) * 4 < len(s) and identifier(s, tokens))


def token_spans(text: str, tokens) -> list[tuple[int, int, int]]:
    return [(m.start(), 3, m.end()) for m in STRING.finditer(text) if len(m[0]) < MAX_CHARS_PER_TOKEN * len(tokens.encode_ordinary(m[0])) and not excluded(m[0], tokens)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_token", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(path: str):
    def run(batches):
        let_go()
        tokens = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, extra = base_spans(text or ""), token_spans(text or "", tokens)
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((doc_id, *n, len(extra), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + extra)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)] if rows else [pa.array([], t) for t in _OUT.types], schema=_OUT)

    return run


def secret_spans(docs: DataFrame, vocabulary: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(vocabulary), "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by MASK."""
    out, at, end = [], 0, -1
    for a, _, b in sorted(spans):
        if a < end:
            end = max(end, b)
            at = max(at, end)
            continue
        out += [text[at:a], MASK]
        at = end = b
    return "".join([*out, text[at:]])


def _redactor(path: str, text_at: int, chars_at: int | None):
    def run(batches):
        let_go()
        tokens = encoder(path)
        for batch in batches:
            texts = [t and redact(t, base_spans(t) + token_spans(t, tokens)) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redacted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All documents and columns, with the secrets of each text masked."""
    small_batches(docs.sparkSession)
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_redactor(vocabulary, docs.columns.index("text"), chars_at), docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
