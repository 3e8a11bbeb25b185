"""Secret scans: fixed patterns, and strings in sensitive places that dictionary-primed compression can't shorten."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import vec

ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "novel")
#: Bytes of a candidate, of the text on each side that it is measured against, and of the text before it that makes it sensitive.
LEAST, AROUND, NEAR = 16, 256, 64
#: Marginal compressed bytes for each byte of a candidate from which it is a secret.
NOVEL = 0.62
SENSITIVE = re.compile(rb"(?i:key|secret|token|passw|passphrase|pwd|auth|credential|bearer|private|access|signature|session|cookie|salt|webhook)")
#: What code and configuration around secrets is made of, most frequent last, where compressors find it cheapest.
IDENTIFIERS = b"""
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example.com localhost changeme placeholder your-key-here
application/json content-type text/html charset=utf-8 https://www. http:// .amazonaws.com s3:// registry docker kubernetes
import from return function const static public private protected class struct interface void string int boolean null true false
def self None True False async await lambda yield raise except finally while break continue
user_name_field_value_data_type_list_item_index_count_size_path_file_line_title_label_group_order_number_status_result
database username hostname port timeout connection endpoint region bucket version release build environment production staging development
client_id client_secret access_key_id secret_access_key refresh_token session_token private_key public_key signing_key encryption_key
authorization: Bearer basic x-api-key api_key apikey api-key auth_token password passwd secret token credentials user login email
"""
_TOKEN = np.array([chr(c).isalnum() and c < 128 or chr(c) in "+/_.=-" for c in range(256)])
_HEX = np.array([chr(c) in "0123456789abcdef" for c in range(256)])
_DIGIT = np.array([48 <= c < 58 for c in range(256)])


def runs(raw: np.ndarray, of: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest runs of the bytes of a table, of `least` or more, that cross no text's border."""
    inside = of[raw]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first, final = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
    begin[first], last[final] = inside[first], inside[final]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    long = ends - begins >= least
    return begins[long], ends[long]


class Novelty:
    def __init__(self) -> None:
        import zstandard

        dictionary = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=9)
        self.size = lambda text, c=zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False): len(c.compress(text))

    def of(self, before: bytes, candidate: bytes, after: bytes) -> float:
        """Compressed bytes that the candidate adds to its surroundings, for each of its bytes."""
        around = before + after
        return (self.size(around + candidate) - self.size(around)) / len(candidate)


@functools.cache
def _novelty() -> Novelty:
    return Novelty()


def find(text: bytes, hexes: list[tuple[int, int]], candidates: list[tuple[int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes of one text, in order."""
    spans = [(a, 2, b) for a, b in hexes]
    low = text.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base = sorted(spans)
    starts, reach = [x for x, _, _ in base], list(itertools.accumulate((y for _, _, y in base), max))
    for a, b in candidates:
        before_b = bisect.bisect_left(starts, b)
        if not (before_b and reach[before_b - 1] > a) and SENSITIVE.search(text, max(0, a - NEAR), a):
            before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
            if novelty.of(before, text[a:b], after) >= NOVEL:
                spans.append((a, 3, b))
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of the secrets in every whole text.

    assign, access and hex are the longest leftmost matches that don't overlap, of each kind for itself; novel are other
    strings of 16 signs or more, with letters and digits, after a sensitive word, that a compressor primed with common
    identifiers and the text around can't shorten below NOVEL bytes a byte. Null and empty texts have none; only doc_id
    and text are read; repeated rows get equal answers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = _novelty()
        for batch in batches:
            column = vec.plain(batch.column(1))
            found: list[list[dict]] = []
            for i in range(0, len(column), 500):
                found += _texts(column[i : i + 500], novelty)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def _texts(column: pa.Array, novelty: Novelty) -> list[list[dict]]:
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = bytes(memoryview(column.buffers()[2])[int(at[0]) : int(at[-1])]) if column.buffers()[2] is not None else b""
    at = at - at[0]
    raw = np.frombuffer(data, np.uint8)
    hexes, candidates = runs(raw, _HEX, at, 24), runs(raw, _TOKEN, at, LEAST)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    letters = np.concatenate([[0], np.cumsum(_TOKEN[raw] & ~_DIGIT[raw])])
    a, b = candidates
    mixed = (digits[b] > digits[a]) & (letters[b] > letters[a])
    a, b = a[mixed], b[mixed]
    hex_at, token_at = np.searchsorted(hexes[0], at), np.searchsorted(a, at)
    out = []
    for row, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        text = data[lo:hi]
        own = [(int(x) - lo, int(y) - lo) for x, y in zip(hexes[0][hex_at[row] : hex_at[row + 1]], hexes[1][hex_at[row] : hex_at[row + 1]], strict=True)]
        more = [(int(x) - lo, int(y) - lo) for x, y in zip(a[token_at[row] : token_at[row + 1]], b[token_at[row] : token_at[row + 1]], strict=True)]
        spans = find(text, own, more, novelty)
        if spans:
            raw_text = np.frombuffer(text, np.uint8)
            points = np.concatenate([[0], np.cumsum(raw_text & 0xC0 != 0x80)])
            out.append([{"kind": KINDS[k], "start": int(points[x]), "end": int(points[y])} for x, k, y in spans])
        else:
            out.append([])
    return out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by the contract; see scan() for what counts as a secret and for nulls."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of one text's spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
