"""Fill-in-the-middle over texts kept as seekable compressed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscheck.llm import arrays as A

# Bytes of text in a frame, at most.
FRAME = 1 << 14
LEVEL = 3
_FRAMES = "array<struct<units:long,chars:long,data:binary>>"


@dataclass(frozen=True)
class Rule:
    """Which texts are turned, where and how; all by a hash of ``seed`` and ``doc_id``."""

    seed: int = 7
    turned: int = 100  # of 100 texts
    suffix_first: int = 50  # of 100 turned texts
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _n_chars(data: bytes | np.ndarray) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _frames(data: np.ndarray, size: int, pack) -> list[dict]:
    """Frames of a text with the units (lines) ended and the characters passed so far."""
    out, at, units, chars = [], 0, 0, 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        part = data[at:end]
        units += int(np.count_nonzero(part == 10))
        chars += _n_chars(part)
        last = end == len(data)
        out.append({"units": units + int(last and part[-1] != 10), "chars": chars, "data": pack(part.tobytes())})
        at = end
    return out


def store(docs: DataFrame, rule: Rule = Rule(), frame: int = FRAME, level: int = LEVEL) -> DataFrame:
    """``docs`` with ``frames`` in place of ``text``: independent zstandard frames of ``frame`` bytes.

    A frame ends between two characters and holds the number of units (lines, the last one
    with or without its break) ended and of characters passed at its end. ``marked`` tells
    that the text has one of the rule's marks. A missing text is an empty one, without
    frames. The table can be written, and turned again by other seeds, without the texts.
    """
    if frame < 4:
        raise ValueError("a frame must hold a character")

    @F.arrow_udf(_FRAMES)
    def compress(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=level).compress
        data, offsets = A.text_buffer(texts)
        rows = [_frames(data[a:b], frame, pack) for a, b in zip(offsets, offsets[1:])]
        kind = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
        return pa.array(rows, pa.list_(kind))

    marks = (rule.prefix, rule.suffix, rule.middle)
    marked = F.greatest(*[F.coalesce(F.col("text").contains(m), F.lit(False)) for m in marks])
    return docs.withColumns({"frames": compress("text"), "marked": marked}).drop("text")


def _after(frames: list[dict], unit: int, unpack) -> tuple[int, bytes, int, int]:
    """Where ``unit`` units have ended: number of the frame, its text, the place there, and characters before it."""
    units = [f["units"] for f in frames]
    k = int(np.searchsorted(units, unit)) if unit else 0
    text = unpack(frames[k]["data"])
    before = frames[k - 1] if k else {"units": 0, "chars": 0}
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    left = unit - before["units"]
    place = 0 if not left else int(breaks[left - 1]) + 1 if left <= len(breaks) else len(text)
    return k, text, place, before["chars"] + _n_chars(text[:place])


def _arrange(frames: list[dict], low: int, high: int, form: str, marks: dict[str, bytes], pack, unpack) -> tuple[list[bytes], int, int]:
    """Frames of the turned text; only those that hold a cut are opened."""
    i, first, x, a = _after(frames, low, unpack)
    j, second, y, b = _after(frames, high, unpack)
    data = [f["data"] for f in frames]
    some = lambda part: [pack(part)] if part else []
    prefix = data[:i] + some(first[:x])
    suffix = some(second[y:]) + data[j + 1 :]
    middle = some(first[x:y]) if i == j else some(first[x:]) + data[i + 1 : j] + some(second[:y])
    order = [("prefix", prefix), ("suffix", suffix)] if form == "psm" else [("suffix", suffix), ("prefix", prefix)]
    return [f for name, part in [*order, ("middle", middle)] for f in [pack(marks[name]), *part]], a, b - a


def turn(stored: DataFrame, rule: Rule = Rule(), level: int = LEVEL) -> DataFrame:
    """A table of :func:`store` with ``n, form, prefix_chars, middle_chars`` and ``output``.

    ``output`` is the turned text as zstandard frames in order; one after the other they
    are a stream that any zstandard reader expands. Frames without a cut pass as they are.
    ``form`` is ``plain`` (empty or marked text, or not chosen; the text as it is, lengths
    null), ``psm`` or ``spm``. A missing id counts as the empty string. Columns of the
    same names are replaced.
    """
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = F.coalesce(F.try_element_at("frames", F.lit(-1))["units"], F.lit(0).cast("long"))
    plain = (F.size("frames") == 0) | F.col("marked") | (h[2] % 100 >= rule.turned)
    form = F.when(plain, "plain").when(h[3] % 100 < rule.suffix_first, "spm").otherwise("psm")
    cuts = [h[k] % (n + 1) for k in (0, 1)]
    marks = {"prefix": rule.prefix.encode(), "suffix": rule.suffix.encode(), "middle": rule.middle.encode()}

    @F.arrow_udf("struct<prefix_chars:long,middle_chars:long,output:array<binary>>")
    def arrange(frames: pa.Array, low: pa.Array, high: pa.Array, form: pa.Array) -> pa.Array:
        pack, unpack = zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress
        out = []
        for k, kind in enumerate(form.to_pylist()):
            row = frames[k].as_py()
            if kind == "plain":
                out.append({"prefix_chars": None, "middle_chars": None, "output": [f["data"] for f in row]})
            else:
                parts, a, m = _arrange(row, low[k].as_py(), high[k].as_py(), kind, marks, pack, unpack)
                out.append({"prefix_chars": a, "middle_chars": m, "output": parts})
        kind = pa.struct([("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
        return pa.array(out, kind)

    done = stored.withColumns({"n": n, "form": form}).withColumn("_turned", arrange("frames", F.least(*cuts), F.greatest(*cuts), "form"))
    made = {name: F.col(f"_turned.{name}") for name in ("prefix_chars", "middle_chars", "output")}
    return done.withColumns(made).drop("frames", "marked", "_turned")


def _sections(chunks: Iterable[bytes], marks: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Bytes behind the k-th mark with k, read as a stream; the first mark begins it, others are looked for in order."""
    at, held = -1, b""
    for chunk in chunks:
        held += chunk
        while at + 1 < len(marks):
            place = held.find(marks[at + 1])
            if place < 0:
                break
            if place:
                yield at, held[:place]
            held = held[place + len(marks[at + 1]) :]
            at += 1
        keep = len(marks[at + 1]) - 1 if at + 1 < len(marks) else 0  # a mark may lie across two frames
        if len(held) > keep:
            yield at, held[: len(held) - keep]
            held = held[len(held) - keep :]
    if held:
        yield at, held


def _restored(output: Iterable[bytes], form: str, rule: Rule, unpack) -> Iterator[bytes]:
    """The text again, from the turned one and its form, in two passes over its frames."""
    if form == "plain":
        yield from (unpack(f) for f in output)
        return
    names = ["prefix", "suffix", "middle"] if form == "psm" else ["suffix", "prefix", "middle"]
    marks = [getattr(rule, name).encode() for name in names]
    for wanted in ({"prefix", "middle"}, {"suffix"}):  # the prefix is before the middle in both forms
        for k, part in _sections((unpack(f) for f in output), marks):
            if names[k] in wanted:
                yield part


def texts(turned: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A table of :func:`turn` with the turned text as ``text`` and the one made from it as ``restored``."""

    @F.arrow_udf("struct<text:string,restored:string>")
    def read(output: pa.Array, form: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = zip(output.to_pylist(), form.to_pylist())
        pairs = [(b"".join(map(unpack, frames)).decode(), b"".join(_restored(frames, kind, rule, unpack)).decode()) for frames, kind in rows]
        return pa.array([{"text": t, "restored": r} for t, r in pairs], pa.struct([("text", pa.string()), ("restored", pa.string())]))

    done = turned.withColumn("_read", read("output", "form"))
    return done.withColumns({"text": F.col("_read.text"), "restored": F.col("_read.restored")}).drop("_read")


def digests(turned: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A table of :func:`turn` with ``output_sha256`` and ``restored_sha256`` in place of ``output``; one frame in memory at a time."""

    @F.arrow_udf("struct<output_sha256:string,restored_sha256:string>")
    def stream(output: pa.Array, form: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for k, kind in enumerate(form.to_pylist()):
            frames = output[k].as_py()
            whole, again = hashlib.sha256(), hashlib.sha256()
            for f in frames:
                whole.update(unpack(f))
            for part in _restored(frames, kind, rule, unpack):
                again.update(part)
            out.append({"output_sha256": whole.hexdigest(), "restored_sha256": again.hexdigest()})
        return pa.array(out, pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())]))

    done = turned.withColumn("_read", stream("output", "form"))
    made = {name: F.col(f"_read.{name}") for name in ("output_sha256", "restored_sha256")}
    return done.withColumns(made).drop("output", "_read")
