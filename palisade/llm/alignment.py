"""Which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers spell a space and the text. Where tokens of both end at the same byte, the text is cut; between two cuts
lies a *group* of tokens that stand for each other. Two tokens are *linked* where their byte ranges overlap.

A range of bytes gives a *fragment*: an open prefix (tokens up to its first cut, whose group began earlier), closed groups,
and an open suffix (tokens after its last cut). Fragments form a monoid: ``joined`` closes the group made of the suffix on
the left and the prefix on the right, and it does not matter in which order neighbours meet. A text of up to ``chunk``
bytes is one fragment. Longer ones are dealt out as byte ranges over all tasks, and a tree of ``fan`` neighbours at a time
puts them together again.

Defined results: a text that is null or empty, or that a tokenizer does not spell back byte by byte, has no tokens (zeros, no
groups, no links). Rows are documents: repeated rows and equal ids count one by one, a null id stays. Of the input only the
id and the text are read, so other columns may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.tokens import RANKS, TOKENIZER, Encoder
from palisade.session import write_through

PIECES = "piece_bpe_32k.model"
#: Bytes up to which a text is one fragment, and of a range of a longer one.
CHUNK = 65_536
#: Neighbouring fragments put together by one task of the tree.
FAN = 8
#: Rows of the table of pairs up to which it is sent to all tasks (16 bytes each); beyond, links are shuffled to it.
BROADCAST_PAIRS = 2_000_000

_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, groups string, links array<struct<a int, b int, n int>>"
_OPEN = "pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>, cut boolean, sound boolean"
_IDS = np.int32


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Spellings:
    """Two tokenizers with the bytes of each of their entries."""

    def __init__(self, a: str | None = None, ranks: str | None = None, b: str | None = None) -> None:
        import sentencepiece

        if a is None:
            import public_tokenizers as known

            a, ranks, b = known.path(TOKENIZER), known.path(RANKS), known.path(PIECES)
        self._a, self._b = Encoder(str(a), ranks and str(ranks)), sentencepiece.SentencePieceProcessor(model_file=str(b))
        self._a.full.encode_special_tokens = True
        sign, full = _byte_of_sign(), self._a.full
        names = [full.id_to_token(i) or "" for i in range(full.get_vocab_size())]
        self.bytes_a = [bytes(sign[c] for c in name) if all(c in sign for c in name) else name.encode() for name in names]
        model = self._b
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.first_b = len(self.bytes_a) * 2
        self.shown = [f"{i}{end}" for n, ends in ((len(names), ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]

    def spell(self, data: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """ids of both for bytes that begin with the space; whether each spells exactly these bytes."""
        text = data.decode()
        a, b = self._a.ids(text).tolist(), self._b.encode(text[1:])
        sound = b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
        return np.array(a, _IDS), np.array(b, _IDS), sound


@lru_cache(2)
def spellings(a: str | None = None, ranks: str | None = None, b: str | None = None) -> Spellings:
    """One pair of tokenizers per Python worker. Without paths: the public files on that machine."""
    return Spellings(a, ranks, b)


def _none() -> np.ndarray:
    return np.empty(0, _IDS)


@dataclass
class Fragment:
    """What a stretch of bytes knows of its groups; ``keys`` and ``times`` are its links (a << 32 | b) and how often."""

    n_a: int = 0
    n_b: int = 0
    pre_a: np.ndarray = field(default_factory=_none)
    pre_b: np.ndarray = field(default_factory=_none)
    suf_a: np.ndarray = field(default_factory=_none)
    suf_b: np.ndarray = field(default_factory=_none)
    n_groups: int = 0
    groups: str = ""
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cut: bool = False
    sound: bool = True


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(times), len(distinct)).astype(np.int64)


def _cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For two ascending lists of ends: where each end of one would stand in the other, and whether it is there."""
    in_b, in_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    return in_b, in_a, np.append(ends_b, -1)[in_b] == ends_a, np.append(ends_a, -1)[in_a] == ends_b


def _closed(s: Spellings, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray, np.ndarray]:
    """Number and text of the groups, links and their times, of tokens that begin and end together."""
    in_b, in_a, cut_a, cut_b = _cuts(np.cumsum(s.size_a[a]), np.cumsum(s.size_b[b]))
    # Up to each end one token of both is on its way; an end of both counts once.
    inner = ~cut_b
    links = np.concatenate([(a.astype(np.int64) << 32) | b[in_b], (a[in_a[inner]].astype(np.int64) << 32) | b[inner]])
    keys, times = np.unique(links, return_counts=True)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    upto_a, upto_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = a + cut_a * len(s.bytes_a)
    shown[np.arange(len(b)) + upto_a[group_b]] = s.first_b + b + cut_b * len(s.bytes_b)
    return len(upto_a), "".join(map(s.shown.__getitem__, shown.tolist()))[:-1], keys, times


def whole(s: Spellings, data: bytes) -> Fragment:
    """The finished fragment of a whole text: nothing in it is open."""
    a, b, sound = s.spell(data)
    return Fragment(len(a), len(b), **dict(zip(("n_groups", "groups", "keys", "times"), _closed(s, a, b)))) if sound else Fragment()


def fragment(s: Spellings, data: bytes, at: int, low: int, high: int) -> Fragment:
    """The fragment of bytes low..high of a text, given the stretch from ``at`` on that lies between two safe places.

    A token belongs to the range in which it ends.
    """
    a, b, sound = s.spell(data)
    if not sound:
        return Fragment(sound=False)
    ends_a, ends_b = at + np.cumsum(s.size_a[a]), at + np.cumsum(s.size_b[b])
    in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
    a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
    cuts = ends_a[_cuts(ends_a, ends_b)[2]]
    if not len(cuts):
        return Fragment(len(a), len(b), a, b)
    pre_a, pre_b = np.searchsorted(ends_a, cuts[0], "right"), np.searchsorted(ends_b, cuts[0], "right")
    suf_a, suf_b = np.searchsorted(ends_a, cuts[-1], "right"), np.searchsorted(ends_b, cuts[-1], "right")
    out = Fragment(len(a), len(b), a[:pre_a], b[:pre_b], a[suf_a:], b[suf_b:], cut=True)
    if len(cuts) > 1:
        out.n_groups, out.groups, out.keys, out.times = _closed(s, a[pre_a:suf_a], b[pre_b:suf_b])
    return out


def joined(s: Spellings, parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments as one, in their order; none is the neutral fragment."""
    out = Fragment(sum(p.n_a for p in parts), sum(p.n_b for p in parts), sound=all(p.sound for p in parts))
    if not out.sound:
        return Fragment(sound=False)
    open_a, open_b, groups, keys, times = [], [], [], [], []
    for p in parts:
        open_a.append(p.pre_a), open_b.append(p.pre_b)
        if not p.cut:
            continue
        a, b = np.concatenate(open_a), np.concatenate(open_b)
        if out.cut:
            n, text, k, t = _closed(s, a, b)
            out.n_groups += n
            groups.append(text), keys.append(k), times.append(t)
        else:
            out.cut, out.pre_a, out.pre_b = True, a, b
        out.n_groups += p.n_groups
        groups += [p.groups] if p.groups else []
        keys.append(p.keys), times.append(p.times)
        open_a, open_b = [p.suf_a], [p.suf_b]
    if open_a:
        rest = np.concatenate(open_a), np.concatenate(open_b)
        if out.cut:
            out.suf_a, out.suf_b = rest
        else:
            out.pre_a, out.pre_b = rest
    out.groups = ";".join(groups)
    if keys:
        out.keys, out.times = _summed(keys, times)
    return out


def finished(s: Spellings, whole: Fragment) -> Fragment:
    """The fragment of a whole text with its first group closed; nothing is open after its last token."""
    if not whole.sound or not whole.cut:
        return Fragment()
    start = Fragment(cut=True)
    return joined(s, [start, whole])


# --- byte ranges of long texts ----------------------------------------------------------------


def _safe(data: bytes, at: int) -> bool:
    """No token of either tokenizer reaches over ``at``: one space between two signs that are none."""
    if data[at] != 32 or at == 0 or at + 1 == len(data):
        return False
    start = at - 1
    while data[start] & 0xC0 == 0x80:
        start -= 1
    return not data[start:at].decode().isspace() and not data[at + 1 : at + 5].decode(errors="ignore")[:1].isspace()


def _next_safe(data: bytes, at: int) -> int:
    while 0 <= (at := data.find(b" ", at)):
        if _safe(data, at):
            return at
        at += 1
    return len(data)


def _last_safe(data: bytes, at: int) -> int:
    while 0 < (at := data.rfind(b" ", 0, at + 1)):
        if _safe(data, at):
            return at
        at -= 1
    return 0


def ranges(data: bytes, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(at, low, high, stretch) for byte ranges of ``chunk`` bytes; one without a safe place grows until it has one."""
    low = 0
    while low < len(data):
        safe = _next_safe(data, low + 1)
        high = min(max(low + chunk, -(-safe // chunk) * chunk), len(data))
        at, end = _last_safe(data, low), _next_safe(data, high) if high < len(data) else high
        yield at, low, high, data[at:end]
        low = high


# --- tables -----------------------------------------------------------------------------------


def _links(parts: list[Fragment]) -> pa.Array:
    sizes = np.cumsum([0, *(len(p.keys) for p in parts)])
    keys = np.concatenate([p.keys for p in parts]) if parts else np.empty(0, np.int64)
    times = np.concatenate([p.times for p in parts]) if parts else np.empty(0, np.int64)
    fields = [(keys >> 32).astype(_IDS), (keys & 0xFFFFFFFF).astype(_IDS), times.astype(_IDS)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(list(map(pa.array, fields)), ["a", "b", "n"]))


def _counts(parts: list[Fragment]) -> dict[str, pa.Array]:
    out = {name: pa.array([getattr(p, name) for p in parts], pa.int64()) for name in ("n_a", "n_b", "n_groups")}
    return out | {"groups": pa.array([p.groups for p in parts], pa.string()), "links": _links(parts)}


def _opens(parts: list[Fragment]) -> dict[str, pa.Array]:
    out = {name: pa.array([getattr(p, name) for p in parts], pa.list_(pa.int32())) for name in ("pre_a", "pre_b", "suf_a", "suf_b")}
    return out | {name: pa.array([getattr(p, name) for p in parts], pa.bool_()) for name in ("cut", "sound")}


def _parts(rows: pa.Table) -> Iterator[Fragment]:
    """Fragments of a table of them."""
    flat = {name: rows[name].to_pylist() for name in ("n_a", "n_b", "n_groups", "groups", "cut", "sound")}
    for i in range(rows.num_rows):
        links = rows["links"][i].values
        a, b, n = (links.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        opens = {name: np.array(rows[name][i].values, _IDS) for name in ("pre_a", "pre_b", "suf_a", "suf_b")}
        yield Fragment(**{k: v[i] for k, v in flat.items()}, **opens, keys=(a << 32) | b, times=n)


def _short(paths: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = spellings(*paths)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = []
            for text in part["text"].to_pylist():
                data = b" " + (text or "").encode()
                found.append(whole(s, data) if text else Fragment())
            yield pa.RecordBatch.from_pydict({"row": part["row"], "doc_id": part["doc_id"], **_counts(found)})


def _dealt(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = b" " + batch["text"][i].as_py().encode()
            for part, (at, low, high, stretch) in enumerate(ranges(data, chunk)):
                place = {"part": part, "at": at, "low": low, "high": high, "stretch": stretch}
                ids = {"row": batch["row"].slice(i, 1), "doc_id": batch["doc_id"].slice(i, 1)}
                yield pa.RecordBatch.from_pydict(ids | {k: [v] for k, v in place.items()})


def _fragments(paths: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = spellings(*paths)
    for batch in batches:
        for i in range(batch.num_rows):
            at, low, high, stretch = (batch[k][i].as_py() for k in ("at", "low", "high", "stretch"))
            found = [fragment(s, stretch, at, low, high)]
            ids = {k: batch[k].slice(i, 1) for k in ("row", "doc_id", "part")}
            yield pa.RecordBatch.from_pydict({**ids, **_counts(found), **_opens(found)})


def aligned(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN, paths: tuple = (),
) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, links) per row; ``row`` is any number of its own.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``links`` are the distinct pairs of ids with the times they overlap.
    ``paths`` are files of the tokenizers (A, A as ranks or None, B). A written result should be read more than once, not this.
    """
    spark = docs.sparkSession
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    head = f"row bigint, doc_id bigint, {_COUNTS}"
    short = given.filter(~is_long).mapInArrow(lambda batches: _short(paths, batches), head)

    place = "row bigint, doc_id bigint, part bigint, at bigint, low bigint, high bigint, stretch binary"
    # Negative, so that no number of a long text is that of a short one, however the two scans are split.
    long = given.filter(is_long).withColumn("row", -F.col("row") - 1).mapInArrow(lambda batches: _dealt(chunk, batches), place)
    kind = f"row bigint, doc_id bigint, part bigint, {_COUNTS}, {_OPEN}"
    parts = write_through(long.repartition("row", "part").mapInArrow(lambda batches: _fragments(paths, batches), kind), "fragments")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1

    def put_together(rows: pa.Table) -> pa.Table:
        s, rows = spellings(*paths), rows.sort_by("part")
        found = [joined(s, list(_parts(rows)))]
        ids = {"row": rows["row"][:1], "doc_id": rows["doc_id"][:1], "part": pa.array([rows["part"][0].as_py() // fan], pa.int64())}
        return pa.table({**ids, **_counts(found), **_opens(found)})

    while left > 1:
        parts = parts.groupBy("row", F.floor(F.col("part") / fan)).applyInArrow(put_together, kind)
        left = -(-left // fan)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = spellings(*paths)
        for batch in batches:
            found = [finished(s, p) for p in _parts(pa.Table.from_batches([batch]))]
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "doc_id": batch["doc_id"], **_counts(found)})

    return short.unionByName(parts.mapInArrow(close, head))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, docs, best) per linked pair: how many rows hold it, and whether no other b of its a is held by more."""
    pairs = rows.select(F.inline("links")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    top = F.max("docs").over(Window.partitionBy("a"))
    return pairs.withColumn("best", F.col("docs") == top)


def link_scores(rows: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of rows with links: links whose pair is the best of its a, and the counts of all links.

    ``pairs`` is counted: up to ``broadcast_pairs`` it goes to every task, above it meets the links in a shuffle.
    """
    known = F.broadcast(pairs) if pairs.count() <= broadcast_pairs else pairs
    found = rows.select("row", F.inline("links")).join(known, ["a", "b"])
    return found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("bigint").alias("n_best"),
        F.sum(F.col("n") * F.col("docs")).cast("bigint").alias("count_sum"),
    )
