"""Events of documents that arrive in chunks: a stateful stream operator for the stream dialect.

State is cut at the last complete token, so that any way to cut a document into chunks gives the events of the whole. Chunks that come
before their turn wait in the state. A document ends with the chunk marked is_last. A token that is not complete is searched for its end in
what is new only, and is put together once its end is there.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import schema as S
from tagloom.functions.text import ENTITIES, NAME, SPACE
from tagloom.schema import EVENTS, ParserOptions

STREAM = ParserOptions(dialect="stream")
_START = re.compile(rf"<({NAME}+)([{SPACE}]+[^>]*?)?[{SPACE}]*(/?)>\Z")
_END = re.compile(rf"</({NAME}+)[{SPACE}]*>\Z")
_ATTRIBUTE = re.compile(rf'({NAME}+)="([^"]*)"')
#: A byte order mark.
_MARK = "\ufeff"
_BLANK = re.compile(rf"[{SPACE}]*\Z")
#: How markup that is passed over or taken as it is begins, what ends it, and how far after its beginning the end may lie.
_SPANS = (("<!--", "-->", 2), ("<![CDATA[", "]]>", 9), ("<?", "?>", 1))


def decoder(options: ParserOptions) -> Callable[[str], str]:
    """Entities decoded once, as functions.text.unescape() does."""
    own = {k: v for k, v in options.entities if k and v}
    table = {k: v for k, v in (ENTITIES | own).items() if k != "&amp;"} | {"&amp;": "&"}
    if not options.decode_entities:
        return lambda x: x
    if own:
        found = re.compile("|".join(map(re.escape, table)))
        return lambda x: found.sub(lambda m: table[m[0]], x)

    def plain(x: str) -> str:
        for k, v in table.items():
            x = x.replace(k, v)
        return x

    return lambda x: plain(x) if "&" in x else x


_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
#: Of an event, as the parser gives it: all columns but doc_id.
_FIELDS = [c for c in _COLUMNS if c != "doc_id"]
#: Longer tags are not remembered.
_SHORT = 64


def _named(name: str) -> tuple[str, str, str | None, str]:
    """A name, its local part, its prefix, and the key to look its namespace up by."""
    prefix, colon, local = name.partition(":")
    return name, local if colon else name, prefix if colon else None, prefix if colon else ""


def _start(piece: str) -> tuple[tuple[str, str, str | None, str], list[tuple[str, str]], bool] | None:
    m = _START.match(piece)
    return (_named(m[1]), _ATTRIBUTE.findall(m[2]) if m[2] else [], bool(m[3])) if m else None


def _end(piece: str) -> tuple[str, str, str | None, str] | None:
    m = _END.match(piece)
    return _named(m[1]) if m else None


_known_start, _known_end = lru_cache(4096)(_start), lru_cache(4096)(_end)


class Incremental:
    """The parser of one document. Feed it bytes; it gives the events that are certain. Options are given with each call: they are no state."""

    def __init__(self) -> None:
        self.waits_for, self.parts = "", []  # the end of the token that is not complete, and what there is of it
        self.texts: list[str] = []
        self.seq = 0
        self.bytes: tuple[Any, ...] | None = None
        self.open: list[tuple[str, int, dict[str, str]]] = []
        self.begun = self.marked = self.over = False
        self.next_chunk, self.waiting = 0, {}
        self._forget()

    def _forget(self) -> None:
        """What is made of the options is made again when it is asked for."""
        self.options: ParserOptions | None = None
        self.reader: Any = None
        self.decoded: Callable[[str], str] = str
        self.utf8 = False

    def __getstate__(self) -> dict[str, Any]:
        held = self.bytes if self.reader is None else self.reader.getstate()
        return {k: v for k, v in self.__dict__.items() if k not in ("options", "reader", "decoded", "utf8")} | {"bytes": held}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self._forget()
        self.__dict__.update(state)

    def _set(self, options: ParserOptions) -> None:
        if self.reader is not None:
            self.bytes = self.reader.getstate()
        self.options, self.decoded, self.utf8 = options, decoder(options), codecs.lookup(options.encoding).name == "utf-8"
        self.reader = codecs.getincrementaldecoder(options.encoding)("replace")
        if self.bytes is not None:
            self.reader.setstate(self.bytes)

    def _event(self, out: list[tuple[Any, ...]], kind: str, error: str | None = None) -> None:
        out.append((self.seq, kind, None, None, None, None, None, None, None, error, 0, None, None, None))
        self.seq += 1

    def _inside(self, out: list[tuple[Any, ...]], kind: str, names: tuple[Any, ...] = (None, None, None, None), attributes: Any = None, infos: Any = None, value: str | None = None) -> None:
        """An event with its place among the open elements."""
        up = self.open
        node, parent, element = (up[-1][1], up[-2][1] if len(up) > 1 else None, up[-1][0]) if up else (None, None, None)
        out.append((self.seq, kind, *names, attributes, infos, value, None, len(up), node, parent, element))
        self.seq += 1

    def _flush(self, out: list[tuple[Any, ...]]) -> None:
        if self.texts:
            value = self.decoded(self.texts[0] if len(self.texts) == 1 else "".join(self.texts))
            self.texts = []
            if not _BLANK.match(value):
                self._inside(out, S.CHARACTERS, value=value)

    def _fail(self, out: list[tuple[Any, ...]], message: str) -> None:
        self.over, self.parts = True, []
        self._event(out, S.ERROR, message)

    def _tag(self, piece: str, out: list[tuple[Any, ...]]) -> None:
        self._flush(out)
        known = len(piece) <= _SHORT
        if piece.startswith("</"):
            found = _known_end(piece) if known else _end(piece)
            if not found:
                self._fail(out, "Malformed closing tag")
            elif not self.open or self.open[-1][0] != found[0]:
                self._fail(out, f"Mismatched closing tag: </{found[0]}>. Expected </{self.open[-1][0] if self.open else 'nothing'}>")
            else:
                self._inside(out, S.END_ELEMENT, (*found[:3], self.open[-1][2].get(found[3])))
                self.open.pop()
            return
        read = _known_start(piece) if known else _start(piece)
        if not read:
            self._fail(out, "Malformed start tag")
            return
        (name, local, prefix, key), pairs, closed = read
        scope, attributes, infos = self.open[-1][2] if self.open else {}, {}, {}
        for k, raw in pairs:
            value = attributes[k] = self.decoded(raw)
            before, colon, after = k.partition(":")
            infos[after if colon else k] = {"value": value, "local_name": None, "prefix": before if colon else None, "uri": scope.get(before) if colon else None}
            if self.options.namespaces and (k == "xmlns" or k.startswith("xmlns:")):
                scope = {**scope, k[6:]: value}  # a tag without declarations shares the scope around it
        self.open.append((name, self.seq, scope))
        names = (name, local, prefix, scope.get(key))
        self._inside(out, S.START_ELEMENT, names, attributes, infos)
        if closed:
            self._inside(out, S.END_ELEMENT, names)
            self.open.pop()

    def read(self, data: bytes, last: bool, options: ParserOptions, out: list[tuple[Any, ...]]) -> None:
        """Put the events that are certain behind `out`, as tuples of _FIELDS."""
        if self.over:
            return
        if options is not self.options:
            self._set(options)
        if not self.begun:
            self.begun = True
            self._event(out, S.START_DOCUMENT)
        new, searched = data.decode() if self.utf8 and not self.reader.buffer and data.isascii() else self.reader.decode(data, last), 0
        if new and not self.marked:
            self.marked, new = True, new.removeprefix(_MARK)
        parts = self.parts
        if parts:
            if self.waits_for and not last:
                n = len(self.waits_for)
                if self.waits_for not in ("".join(parts[-n:])[1 - n :] + new if n > 1 else new):
                    if new:
                        parts.append(new)
                    return
            held = parts[0] if len(parts) == 1 else "".join(parts)
            new, searched = held + new, len(held)
        buffer, at, self.parts = new, 0, []
        self.waits_for, unfinished = "", ""
        size = len(buffer)
        while at < size and not self.over:
            if buffer[at] != "<":
                end = buffer.find("<", at)
                end = size if end < 0 else end
                self.texts.append(buffer[at:end])
                at = end
                continue
            span, rest = None, buffer[at : at + 9]
            if rest[1:2] in ("", "!", "?"):
                if not last and any(len(rest) < len(b) and b.startswith(rest) for b, _, _ in _SPANS):
                    break  # it may yet become one of them
                span = next(((b, e, skip) for b, e, skip in _SPANS if rest.startswith(b)), None)
            begin, stop = at + (span[2] if span else 0), span[1] if span else ">"
            end = buffer.find(stop, max(begin, searched - len(stop) + 1) if at == 0 else begin)
            if end < 0:
                unfinished, self.waits_for = rest, stop
                break
            end += len(stop)
            if not span:
                self._tag(buffer[at:end], out)
            elif span[0] == "<![CDATA[":
                self._inside(out, S.CDATA, value=buffer[at + 9 : end - 3])
            at = end
        if self.over:
            return
        self.parts = [buffer[at:]] if at < size else []
        if last:
            self.over, self.parts = True, []
            waits = unfinished.startswith(("<!--", "<![CDATA[", "<?"))
            if not self.open or not waits:
                self._flush(out)
            if self.open:
                self._fail(out, "Unexpected end of document. Not all elements were closed.")
            else:
                self._event(out, S.END_DOCUMENT)

    def take(self, number: int, data: bytes, last: bool, options: ParserOptions, out: list[tuple[Any, ...]]) -> None:
        """A chunk, and those that waited for it."""
        if number == self.next_chunk and not self.waiting:
            self.next_chunk += 1
            self.read(data, last, options, out)
            return
        if number >= self.next_chunk:
            self.waiting[number] = (data, last)
        while self.next_chunk in self.waiting:
            data, last = self.waiting.pop(self.next_chunk)
            self.next_chunk += 1
            self.read(data, last, options, out)

    def feed(self, data: bytes, last: bool, options: ParserOptions = STREAM) -> list[dict[str, Any]]:
        out: list[tuple[Any, ...]] = []
        self.read(data, last, options, out)
        return [dict(zip(_FIELDS, e, strict=True)) for e in out]

    def chunk(self, number: int, data: bytes, last: bool, options: ParserOptions = STREAM) -> list[dict[str, Any]]:
        out: list[tuple[Any, ...]] = []
        self.take(number, data, last, options, out)
        return [dict(zip(_FIELDS, e, strict=True)) for e in out]


def parse(xml: str | None, options: ParserOptions = STREAM) -> list[dict[str, Any]]:
    """All events of a text."""
    return Incremental().feed((_MARK + (xml or "")).encode(), True, replace(options, encoding="utf-8"))


def _frame(doc_id: int, rows: list[tuple[Any, ...]]) -> pd.DataFrame:
    frame = pd.DataFrame([(doc_id, *r) for r in rows], columns=["doc_id", *_FIELDS])[_COLUMNS]
    for c, kind in (("seq", "Int64"), ("depth", "Int32"), ("node_id", "Int64"), ("parent_id", "Int64")):
        frame[c] = frame[c].astype(kind)
    return frame


def _read(parser: Incremental, frames: list[pd.DataFrame], options: ParserOptions) -> list[tuple[Any, ...]]:
    rows: list[tuple[Any, ...]] = []
    for chunk in pd.concat(frames).sort_values("chunk_seq").itertuples():
        parser.take(int(chunk.chunk_seq), bytes(chunk.bytes or b""), bool(chunk.is_last), options, rows)
    return rows


def parse_stream(chunks: DataFrame, options: ParserOptions = STREAM, keep: int | None = None) -> DataFrame:
    """Events of a stream of chunk rows (sources.documents.CHUNKS); append mode.

    When a document has ended, its state shrinks to an empty mark, so that a chunk that comes again changes nothing. For streams that
    run on for good: the mark goes after `keep` milliseconds (with it, such a query starts a batch even if there is nothing new).
    """

    def update(key: tuple[int], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if keep and state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        if held == b"":
            list(frames)
            if keep:
                state.setTimeoutDuration(keep)
            return
        parser = pickle.loads(held) if held else Incremental()
        rows = _read(parser, list(frames), options)
        state.update((b"" if parser.over else pickle.dumps(parser),))
        if parser.over and keep:
            state.setTimeoutDuration(keep)
        if rows:
            yield _frame(key[0], rows)

    return chunks.groupBy("doc_id").applyInPandasWithState(update, EVENTS, "parser binary", "append", "ProcessingTimeTimeout" if keep else "NoTimeout")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_ARROW[f"map<string,{S.ATTRIBUTE_INFO}>"] = pa.map_(pa.string(), pa.struct([(c, pa.string()) for c in ("value", "local_name", "prefix", "uri")]))
_TYPES = [_ARROW[c.split()[1]] for c in EVENTS.split(", ")]
_PACKED = "doc_id bigint, first bigint, sizes array<int>, bytes binary, is_last boolean"
#: Bytes after which a packed row ends, and events and bytes after which events are handed on.
_PACK, _EVENTS, _BYTES = 1 << 12, 10_000, 1 << 22


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that lie one behind the other as one row, with their sizes: the bytes stay where they are, only the offsets become fewer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, number, data, last = batch.columns
        data, last = pc.fill_null(data, b""), pc.fill_null(last, False).to_numpy(zero_copy_only=False)
        wide = np.int64 if pa.types.is_large_binary(data.type) else np.int32
        at = np.frombuffer(data.buffers()[1], wide)[data.offset : data.offset + n + 1]
        ids, missing, place = pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), number.to_numpy()
        fresh = np.ones(n, bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1]) | (place[1:] != place[:-1] + 1) | last[:-1] | (at[1:-1] // _PACK != at[:-2] // _PACK)
        begin = np.flatnonzero(fresh)
        ends = np.append(begin, n)
        sizes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.diff(at), pa.int32()))
        whole = pa.Array.from_buffers(data.type, len(begin), [None, pa.py_buffer(np.ascontiguousarray(at[ends])), data.buffers()[2] or pa.py_buffer(b"")])
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(begin)), pa.array(place[begin]), sizes, whole, pa.array(last[ends[1:] - 1])], ["doc_id", "first", "sizes", "bytes", "is_last"])


def parse_chunks(chunks: DataFrame, options: ParserOptions = STREAM) -> DataFrame:
    """The same for a table of chunks: each document is read chunk by chunk. A chunk without a number has no place in its document.

    Chunks that lie together move as one row and are cut again behind the shuffle. A partition is read by document and number, and events are handed
    on as they come, so neither a document nor its events are held whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, of, size = Incremental(), None, 0
        ids: list[int | None] = []
        rows: list[tuple[Any, ...]] = []

        def events() -> pa.RecordBatch:
            found = dict(zip(_FIELDS, zip(*rows, strict=True), strict=True)) | {"doc_id": ids}
            for c in ("attributes", "attributes_with_prefix"):
                found[c] = [x if x is None else list(x.items()) for x in found[c]]
            return pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in zip(_COLUMNS, _TYPES, strict=True)], _COLUMNS)

        for batch in batches:
            doc, first, cut, data, last = batch.columns
            cuts, each = cut.offsets.to_numpy().tolist(), cut.values.to_numpy().tolist()
            for doc_id, number, begin, end, whole, ends in zip(doc.to_pylist(), first.to_numpy().tolist(), cuts, cuts[1:], data.to_pylist(), last.to_pylist(), strict=False):
                if doc_id != of:
                    parser, of = Incremental(), doc_id
                at, take, final = 0, parser.take, end - 1 if ends else -1
                for i in range(begin, end):
                    n = at + each[i]
                    take(number, whole[at:n], i == final, options, rows)
                    number, at = number + 1, n
                ids += [doc_id] * (len(rows) - len(ids))
                size += len(whole)
                if len(rows) >= _EVENTS or size >= _BYTES:
                    if rows:
                        yield events()
                    ids, rows, size = [], [], 0
        if rows:
            yield events()

    found = chunks.where("chunk_seq is not null").select(F.col("doc_id").cast("long"), F.col("chunk_seq").cast("long"), F.col("bytes").cast("binary"), F.col("is_last").cast("boolean"))
    packed = found.mapInArrow(_packed, _PACKED).repartition("doc_id").sortWithinPartitions("doc_id", "first")
    return packed.mapInArrow(read, EVENTS)
