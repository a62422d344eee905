"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

Beside the patterns, a candidate is a long run of token characters that follows a sensitive word. Its
novelty is what it adds to the compressed size of its surroundings, per byte, when the zstandard
compressor already knows a dictionary of common identifiers. Names, paths and words repeat what stands
around them or in the dictionary and cost little; keys and passwords cost nearly all their bytes, or,
where the compressor writes fewer bits for each character of a small alphabet, what random characters of
that alphabet cost in the same place. A long candidate is judged by its stretches, so that length
does not lower the verdict.
Everything is within a row: no shuffle, memory is one Arrow batch.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from palisade.llm.text import free_names

KINDS = ("assign", "access", "hex", "novel")
# Fixed values of the base rules.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_LEAST_VALUE = 8

_CONTEXT = re.compile(r"key|secret|token|passw|pwd|credential|auth|bearer|private|signature", re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_=~-]+")
#: What goes on with a candidate after white space (lines of a key) or a dot (parts of a token); what ends a key.
_NEXT = re.compile(r"(?:\s+|\.)([A-Za-z0-9+/_=~-]+)")
_LAST = re.compile(r"\s*-----END")
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_secret client_id "
    "auth authorization bearer credential credentials signature session cookie certificate BEGIN END RSA PRIVATE KEY "
    "/usr/local/share/lib/bin/home/etc/var/src/main/test/tmp/opt/data/ .py .js .java .json .xml .html .txt "
    "username user_name user_id account_id tenant_id project_id config configuration settings environment variable "
    "default example placeholder changeme your_api_key_here undefined null true false return function class import from "
    "export const let var public static void string integer boolean private protected interface implements extends "
    "request response header headers content-type application/json https://www.example.com/index.html http://localhost:8080 "
    "database connection host port name value index count number length size list array object document version release "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000"
)


#: Whole alphabets of encodings; a candidate of other characters is taken to be of all letters of its cases, digits and signs.
_ALPHABETS = ("0123456789ABCDEF", "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + "234567")
#: Random strings that a candidate is held against.
_SAMPLES = 3


def _alphabet(run: str) -> str:
    """The characters that a run is drawn from."""
    own = set(run)
    for one in _ALPHABETS:
        if own.issubset(one):
            return one
    kinds = [kind for kind in (string.ascii_uppercase, string.ascii_lowercase, string.digits) if not own.isdisjoint(kind)]
    return "".join(sorted(own.union(*kinds)))


@functools.lru_cache(4096)
def _sample(alphabet: str, n: int, seed: int) -> bytes:
    return "".join(random.Random(seed).choices(alphabet, k=n)).encode()


def _is_mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


@dataclass(frozen=True)
class Novelty:
    """When a candidate is reported: ``least`` characters, ``reach`` characters after a sensitive word, and of one stretch of
    ``width`` characters ``share`` new bytes per byte, or ``like`` times the new bytes of random characters of its alphabet."""

    least: int = 16
    share: float = 0.95
    like: float = 0.85
    width: int = 32
    reach: int = 48
    around: int = 256
    level: int = 3
    identifiers: str = IDENTIFIERS


class Scanner:
    def __init__(self, novelty: Novelty) -> None:
        self.novelty = novelty
        known = zstandard.ZstdCompressionDict(novelty.identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=novelty.level)
        self.compress = zstandard.ZstdCompressor(
            dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress

    def base(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, kind, end, start of the value) of the base rules, by start and kind."""
        found = []
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            found += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
        found.sort()
        return found

    def is_novel(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end], or a stretch of it, adds to its compressed surroundings what a random string would."""
        n = self.novelty
        around = (text[max(0, start - n.around) : start] + text[end : end + n.around]).encode("utf-8", "surrogatepass")
        known = len(self.compress(around))
        width = min(n.width, end - start)
        drawn = None
        for at in [*range(start, end - width, max(1, width // 2)), end - width]:
            value = text[at : at + width]
            if not _is_mixed(value):
                continue
            added = len(self.compress(around + value.encode())) - known
            if added >= n.share * width:
                return True
            if drawn is None:
                alphabet = _alphabet(text[start:end])
                drawn = sum(len(self.compress(around + _sample(alphabet, width, k))) - known for k in range(_SAMPLES)) / _SAMPLES
            if added >= n.like * drawn:
                return True
        return False

    def novel(self, text: str, taken: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Incompressible strings in sensitive context that no base span touches."""
        n, found, seen = self.novelty, [], -1
        for word in _CONTEXT.finditer(text):
            for run in _RUN.finditer(text, max(word.end(), seen), min(len(text), word.end() + n.reach)):
                start = run.start()
                if start < seen:
                    continue
                # A run that the sensitive word is part of, or that began before the reach, is no candidate of its own.
                if start == word.end() and text[start - 1 : start].isalnum():
                    continue
                end = _RUN.match(text, start).end()
                seen = max(seen, end)
                if end - start < n.least or any(s < end and start < e for s, _, e, _ in taken):
                    continue
                if self.is_novel(text, start, end):
                    for start, end in self.continued(text, start, end, taken):
                        found.append((start, 3, end, start))
                        seen = max(seen, end)
        return found

    def continued(self, text: str, start: int, end: int, taken: Sequence[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
        """A reported run and those that carry it on: novel, as long as the one before, or the rest before the end of a key."""
        while True:
            yield start, end
            after, length = _NEXT.match(text, end), end - start
            if not after:
                return
            start, end = after.span(1)
            if any(s < end and start < e for s, _, e, _ in taken):
                return
            if end - start < self.novelty.least:
                if not _LAST.match(text, end):
                    return
            elif not (end - start == length and _is_mixed(text[start:end])) and not self.is_novel(text, start, end):
                return

    def spans(self, text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.novel(text, base))


def _joined(spans: Sequence[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _scanned(novelty: Novelty):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novelty)
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, every = scanner.spans(text or "")
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, novelty: Novelty = Novelty(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of base spans, their digest, and all spans as kind:start:end in code points.

    A null text is an empty one and has no spans. Spans of different kinds may overlap; ties of start
    are ordered by kind. Null or repeated doc_ids are carried as they are; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(
        _scanned(novelty), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def _redacted(novelty: Novelty, at: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novelty)
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, last = [], 0
                    for start, end in _merged(scanner.spans(text)[1]):
                        parts += [text[last:start], mark]
                        last = end
                    text = "".join([*parts, text[last:]]) if parts else text
                texts.append(text)
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _merged(spans: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Values of the spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((value, end) for _, _, end, value in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(docs: DataFrame, novelty: Novelty = Novelty(), text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret value in ``text`` replaced by ``mark``; the key of an assignment stays.

    No row is dropped. ``length`` names a column that holds the number of characters and is brought
    up to date where it is not null. Null texts stay null.
    """
    (own,) = free_names(docs, "__text")
    names = [own if c == text else c for c in docs.columns]  # a plain name, whatever the column is called
    rows = docs.toDF(*names)
    out = rows.mapInArrow(_redacted(novelty, names.index(own), mark), rows.schema).toDF(*docs.columns)
    if length is None or length not in docs.columns:
        return out
    kind = docs.schema[length].dataType
    new = F.when(F.col(f"`{length}`").isNotNull(), F.coalesce(F.length(f"`{text}`").cast(kind), F.col(f"`{length}`")))
    return out.withColumn(length, new)
