"""Secret scan with a recursive decoding worklist.

The text itself is the first layer. Every layer is scanned for secrets and for encoded stretches: percent-encoded bytes
and Unicode escapes are unwrapped in place, Base64 runs become layers of their own, unpacked for as long as they hold gzip,
zlib, bzip2, xz or Zstandard data; lines wrapped at one width of 16 signs or more are one run as well, and of a run that
cannot be read the parts behind '/', '-' or '_' are tried. New layers join the worklist until none is left; a layer whose content was seen before
at the same place of the text is not taken again, so cycles end and repeated stretches all count. Each character of a layer knows the stretch of the original text that it
comes from, so every span found maps back.

Defined results: a null text counts as empty; an empty text has no span; a null doc_id stays null; repeated rows are
scanned each; equal spans of one kind count once; spans are ordered by start, kind (assign, access, hex), end; an empty
table gives an empty result. Nothing is dropped for its size: unpacked data of any length are scanned, those over ``BLOCK``
bytes as a stream (a decompression bomb takes time, not memory). Only doc_id and text are read, so further columns may have
any name.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, flat

#: Kinds in the order of the result; (pattern, group whose length counts, least length).
PATTERNS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = list(PATTERNS)
#: Unpacked bytes that are held at once; longer data are read as a stream, block by block.
BLOCK = 4 << 20
#: Bytes that a block without any sign to cut at takes from the one before.
OVERLAP = 64 << 10
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Signs of the standard and of the URL alphabet, and those among them that also stand before a stretch.
_ALPHABETS = [(re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile("/")), (re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile("[-_]"))]
#: Lines of Base64, each but the first with nothing else before it, and each but the last with nothing behind it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_UNREADABLE = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\udc80-\\udcff]")
#: Signs that stand in no secret and in no encoded stretch.
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=:"'\s%\\{}-]""")
_MAGIC = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78]")
_B64_BYTE = np.zeros(256, bool)
_B64_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 45, 95]] = True

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """The spans of the text itself."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        p, group, least = PATTERNS["assign"]
        out += [(m.start(), 0, m.end()) for m in p.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        p, group, least = PATTERNS["access"]
        out += [(m.start(), 1, m.end()) for m in p.finditer(text) if m.end() - m.start() >= least]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]  # runs are maximal, so this drops the short ones only
    return sorted(out)


def _readable(raw: bytes) -> str | None:
    """The text of bytes that are UTF-8 without control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _UNREADABLE.search(text) else None


_ZSTANDARD = type(zstandard.ZstdDecompressor().decompressobj())
_PIECE = 1 << 20


class _Broken(Exception):
    """Data that are not packed, or whose first member has no end."""


class _Member:
    """One member of packed data, unpacked in bounded pieces; ``eof`` and ``unused_data`` as usual."""

    def __init__(self, d):
        self.d, self.eof, self.unused_data = d, False, b""

    def steps(self, data: bytes) -> Iterator[bytes]:
        if isinstance(self.d, _ZSTANDARD):  # its output has no bound, so it gets little at a time
            for i in range(0, len(data), 64):
                piece = self.d.decompress(data[i : i + 64])
                if self.d.eof:
                    self.eof, self.unused_data = True, self.d.unused_data + data[i + 64 :]
                yield piece
                if self.eof:
                    return
            return
        piece = self.d.decompress(data, _PIECE)
        while True:
            yield piece
            if self.d.eof:
                self.eof, self.unused_data = True, self.d.unused_data
                return
            data = getattr(self.d, "unconsumed_tail", b"")
            if not data and getattr(self.d, "needs_input", True):
                return
            piece = self.d.decompress(data, _PIECE)


def _member(head: bytes) -> _Member | None:
    """For data that begin so, or None."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0):
        return _Member(zlib.decompressobj(47))
    if head[:3] == b"BZh":
        return _Member(bz2.BZ2Decompressor())
    if head[:6] == b"\xfd7zXZ\x00":
        return _Member(lzma.LZMADecompressor())
    return _Member(zstandard.ZstdDecompressor().decompressobj()) if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _unpacked(source: Iterator[bytes]) -> Iterator[bytes | None]:
    """What gzip, zlib, bzip2, xz or Zstandard data hold, all members of one format, in pieces, and None after each member.
    Data behind the members, and a later member that breaks off, end it."""
    data, magic = b"", b""
    while True:
        while len(data) < 6 and (more := next(source, None)) is not None:
            data = (data + more).lstrip(b"\0") if magic else data + more
        if (d := _member(data)) is None or (magic and data[:3] != magic):
            if magic:
                return
            raise _Broken
        first, magic = not magic, data[:3]
        try:
            while True:
                yield from d.steps(data)
                if d.eof:
                    break
                if (data := next(source, None)) is None:
                    raise EOFError
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError) as e:
            if first:
                raise _Broken from e
            return
        yield None
        data = d.unused_data.lstrip(b"\0")


Source = Callable[[], Iterator[bytes]]


def _first(source: Source, size: int) -> Iterator[bytes]:
    """The first ``size`` bytes of what the source holds packed."""
    for piece in _unpacked(source()):
        if piece and size:
            yield piece[:size]
            size -= min(size, len(piece))


def _opened(source: Source) -> tuple[Source, bytes] | None:
    """What all whole members of a source hold, as a source, and its digest; None if it holds no packed data."""
    held, size, whole, digest, found = [], 0, 0, hashlib.blake2b(digest_size=16), b""
    try:
        for piece in _unpacked(source()):
            if piece is None:
                whole, found = size, digest.digest()
                continue
            size += len(piece)
            digest.update(piece)
            if size <= BLOCK:
                held.append(piece)
            else:
                held.clear()
    except _Broken:
        return None
    raw = b"".join(held)[:whole]
    return (lambda: iter([raw])) if size <= BLOCK else (lambda: _first(source, whole)), found


def unpack(raw: bytes) -> bytes | None:
    """What packed data hold, in memory."""
    return None if (found := _opened(lambda: iter([raw]))) is None else b"".join(found[0]())


def _texts(source: Source) -> Iterator[str]:
    """The text of a source, if all of it can be read: whole, or in blocks of about BLOCK characters that end where no secret
    and no encoded stretch can go on. (Where a block has no such place, the next one repeats its last OVERLAP signs; parts
    of a secret of that length are secrets of the same kind.)"""

    def pieces() -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")()
        for piece in source():
            yield decoder.decode(piece)
        yield decoder.decode(b"", True)

    try:
        if any(_UNREADABLE.search(text) for text in pieces()):
            return
    except UnicodeDecodeError:
        return
    held = ""
    for text in pieces():
        held += text
        while len(held) > BLOCK:
            cuts = [m.end() for m in _BREAK.finditer(held, BLOCK // 2, BLOCK)]
            at = cuts[-1] if cuts else BLOCK
            yield held[:at]
            held = held[at if cuts else at - OVERLAP :]
    if held:
        yield held


class Layer:
    """A text and, for each character, where its source in the original text begins and ends."""

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray):
        self.text, self.begin, self.end = text, begin, end

    def key(self) -> bytes:
        """A digest of the text and where it comes from."""
        return hashlib.blake2b(b"".join([self.text.encode("utf-8", "surrogatepass"), self.begin.tobytes(), self.end.tobytes()]), digest_size=16).digest()

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """A layer with each part (from, to, text) put in place; its characters share the source of the whole part."""
        text, begin, end, at = [], [], [], 0
        for a, b, new in parts:
            text += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        return Layer("".join([*text, self.text[at:]]), np.concatenate([*begin, self.begin[at:]]), np.concatenate([*end, self.end[at:]]))


def _percent(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PERCENT.finditer(text):
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        i = 0
        while i < len(raw):  # one character at a time, so that each maps to its own bytes; what is no UTF-8 stays
            for n in (1, 2, 3, 4):
                try:
                    char = raw[i : i + n].decode()
                except UnicodeDecodeError:
                    continue
                if char:
                    yield at + 3 * i, at + 3 * (i + n), char
                break
            else:
                n = 1
            i += n


def _escapes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ESCAPE.finditer(text):
        a, kind = m.start(), m[0][:3]
        if kind == "\\u{" or kind[1] == "U":
            code = int(m[0].strip("\\uU{}"), 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                yield a, m.end(), chr(code)
        elif kind[1] == "x":
            raw = bytes.fromhex(m[0].replace("\\x", ""))
            if raw.isascii():
                yield from ((a + 4 * i, a + 4 * i + 4, chr(c)) for i, c in enumerate(raw))
            else:
                yield a, m.end(), raw.decode("utf-8", "surrogateescape") if _readable(raw) else raw.decode("latin-1")
        else:
            units = [int(x, 16) for x in m[0][2:].split("\\u")]
            i = 0
            while i < len(units):
                if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                    yield a + 6 * i, a + 6 * i + 12, chr(0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00)
                    i += 2
                else:
                    if not 0xD800 <= units[i] < 0xE000:
                        yield a + 6 * i, a + 6 * i + 6, chr(units[i])
                    i += 1


def _bytes(signs: str) -> bytes:
    """What the signs of either alphabet stand for."""
    body = signs.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)


def _content(raw: bytes) -> tuple[Iterator[str], bool]:
    """The readable text of bytes (in blocks, if it is long; none, if it can't be read), and whether it was packed."""
    if _member(raw) is None or (found := _opened(lambda: iter([raw]))) is None:
        return iter([text] if (text := _readable(raw)) is not None else []), False
    seen = set()
    while found is not None and found[1] not in seen:  # packed data inside packed data
        source, digest = found
        seen.add(digest)
        found = _opened(source)
    return _texts(source), True


def _tails(signs: str, separator: re.Pattern[str]) -> Iterator[tuple[int, str, bool]]:
    """(first sign, text, whether packed) of the parts behind a separator that can be read to their end. Parts that begin
    in step share their bytes, so the signs are decoded four times at most, and of the parts in step the longest counts."""
    steps: dict[int, list[int]] = {}
    for m in separator.finditer(signs):
        if len(signs) - m.end() >= 16:
            steps.setdefault(m.end() % 4, []).append(m.end())
    for step, begins in steps.items():
        raw = _bytes(signs[step:])
        text = raw.decode("utf-8", "surrogateescape")
        text = text[max((m.end() for m in _UNREADABLE.finditer(text)), default=0) :]
        least = len(raw) - len(text.encode())  # all that can be read to the end begins from here
        for at in begins:
            i = (at - step) // 4 * 3
            if _MAGIC.match(raw, i):
                inner, packed = _content(raw[i:])
                if packed:
                    yield from ((at, text, True) for text in inner)
            if least <= i < len(raw) and raw[i] & 0xC0 != 0x80:
                yield at, raw[i:].decode(), False
                least = len(raw)


def _contents(signs: str) -> Iterator[tuple[int, int, str, bool]]:
    """(first sign, end, text, whether packed) of the stretches of one alphabet, or of their readable parts."""
    seen = set()
    for alphabet, separator in _ALPHABETS:
        for m in alphabet.finditer(signs):
            texts, packed = (iter(()), False) if m.span() in seen else _content(_bytes(m[0]))
            seen.add(m.span())
            none = True
            for text in texts:
                none = False
                yield *m.span(), text, packed
            if none:
                yield from ((m.start() + at, m.end(), *found) for at, *found in _tails(m[0], separator))


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Signs of both alphabets and where each stands: runs, and lines wrapped at one width, of which the last may be
    shorter (it is left out too) and the first may have more before it."""
    for m in _RUN.finditer(text):
        yield m[0], np.arange(*m.span())
    for block in _WRAPPED.finditer(text):
        lines = [m.span() for m in _LINE.finditer(text, *block.span())]
        lines[-1], wide = (lines[-1][0], block.end()), [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and wide[j] == wide[i]:
                j += 1
            if wide[i] >= 16:
                for first in {i, 0 if i == 1 and wide[0] > wide[1] else i}:
                    for last in [j, j + 1] if j < len(lines) and wide[j] < wide[i] else [j]:
                        if last - first > 1:
                            part = lines[first:last]
                            yield "".join(text[a:b] for a, b in part), np.concatenate([np.arange(a, b) for a, b in part])
            i = j


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    for find in (_percent, _escapes):
        if parts := [p for p in find(layer.text) if p[1] > p[0]]:
            yield layer.replaced(parts)
    for signs, place in _runs(layer.text):
        for a, b, text, packed in _contents(signs):
            own = place[a:b]
            if packed:
                yield Layer(text, np.full(len(text), layer.begin[own[0]]), np.full(len(text), layer.end[own[-1]]))
            else:
                first = np.cumsum([0, *(len(c.encode()) for c in text)])  # bytes of each character: 3 of them come of 4 signs
                yield Layer(text, layer.begin[own[first[:-1] * 4 // 3]], layer.end[own[np.minimum(-(-first[1:] * 4 // 3), len(own)) - 1]])


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans and those of every layer below, as stretches of the text."""
    found = set(base)
    begin = np.arange(len(text))
    first = Layer(text, begin, begin + 1)
    seen, work = {first.key()}, [_unwrapped(first)]
    while work:  # depth first: of each layer above, only the place where it was left is kept
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif new.text and (key := new.key()) not in seen:
            seen.add(key)
            found |= {(int(new.begin[a]), kind, int(new.end[b - 1])) for a, kind, b in base_spans(new.text)}
            work.append(_unwrapped(new))
    return sorted(found)


def scan(batch_text: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """The text, base spans and all spans of each row."""
    data, off = flat(batch_text)
    # rows with a run of 16 signs of the Base64 alphabets: only there can a long hexadecimal or Base64 run be; a sign of
    # no run stands before each row and after the last, so that no run reaches over a border
    border = off + np.arange(len(off))
    inside = np.insert(_B64_BYTE[data], off, False)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    long_run = edge[0::2][edge[1::2] - edge[0::2] >= 16]
    with_run = np.zeros(len(off), bool)
    with_run[np.searchsorted(border, long_run, "right") - 1] = True
    raw = data.tobytes()
    for i in range(len(off) - 1):
        part = raw[off[i] : off[i + 1]]
        wrapped = with_run[i] or b"%" in part or b"\\" in part
        if not (wrapped or b"=" in part or b":" in part or b"AKIA" in part):
            yield "", [], []
            continue
        text = part.decode()
        base = base_spans(text)
        yield text, base, all_spans(text, base) if wrapped else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, SHA-256 of the base spans, and all spans, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [([sum(k == x for _, k, _ in base) for x in range(3)], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)) for _, base, every in scan(batch.column(1))]
            yield pa.record_batch([batch.column(0), *(pa.array([r[0][x] for r in rows], pa.int64()) for x in range(3)), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], schema=schema)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; every secret of the text is replaced by ``mark``, and n_chars (where there is
    such a column) follows. Other texts stay as they are."""
    schema, at = docs.schema, docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for i, (text, _, spans) in enumerate(scan(batch.column(at))):
                if spans:
                    out, done = [], 0
                    for a, _, b in spans:
                        if a >= done:
                            out += [text[done:a], mark]
                        done = max(done, b)
                    changed[i] = "".join([*out, text[done:]])
            if changed:
                for column, new in ((at, changed), *(((size, {i: len(t) for i, t in changed.items()}),) if size is not None else ())):
                    old = batch.column(column)
                    mask = np.zeros(batch.num_rows, bool)
                    mask[list(new)] = True
                    filled = pa.compute.replace_with_mask(old, pa.array(mask), pa.array(list(new.values())).cast(old.type))
                    batch = batch.set_column(column, batch.schema.field(column), filled)
            yield batch

    return bounded(docs).mapInArrow(run, schema)
