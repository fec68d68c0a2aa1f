"""Offset-preserving SentencePiece encoding and decoding (operator 3).

A text is normalised by the model's compiled character map, a double-array
trie of which the longest matching prefix is replaced at each step.  The
boundaries of the steps are kept in both texts, so that every piece, found in
the normalised text, is projected to a span of bytes of the original one.
Then the byte-pair merges follow: the adjacent pair whose joined piece scores
best is merged first, the leftmost one at a tie.  Characters without a piece
become byte pieces.

No piece of such a vocabulary has a space mark behind another character, so
merges never cross from a word into the next mark and each marked word can be
encoded on its own; equal words are encoded once for each worker process, in
a table of bounded size.

Scale: rows are independent, nothing is shuffled; memory is that of one batch
of bounded size, or of one text.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

MARK = "▁"
#: Words kept with their pieces in each worker process; beyond it the table starts anew.
REMEMBERED = 400_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest prefix of ``raw[at:]`` in the map."""
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, start
        if best is None:
            return None
        return best[0], self.replacements[best[1] : self.replacements.index(b"\0", best[1])]


class PieceModel:
    """The parts of a SentencePiece BPE model that encoding and decoding need."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self._take(model)

    def _take(self, model) -> None:
        trainer, spec = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != 2 or kinds & {4, 5} or trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models with marks in front, without user-defined or unused pieces, are read")
        self.names = [p.piece for p in model.pieces]
        self.costs = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.pieces = {p.piece: i + (len(p.piece.encode("utf-8")) << 32) for i, p in enumerate(model.pieces) if p.type == 1}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unknown_text = trainer.unk_surface if trainer.HasField("unk_surface") else " ⁇ "
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = {b: i for i, b in self.byte_of.items()} if trainer.byte_fallback else {}
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        inside = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.parts = re.compile(f"(?s).+" if inside else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.plain = [p.replace(MARK, " ") for p in self.names]
        for i in self.control:
            self.plain[i] = ""
        self.plain[self.unknown] = self.unknown_text
        self.special = np.zeros(len(self.names), bool)
        self.special[list(self.byte_of) + [self.unknown]] = True
        self.known: dict[str, bytes] = {}

    # -- normalisation ----------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and the boundaries of its steps as byte offsets in it and in ``text``."""
        raw = text.encode("utf-8")
        if self.map is None and not self.squeeze:
            if not raw:
                return "", np.zeros(1, np.int64), np.zeros(1, np.int64)
            widths = np.ones(len(raw), np.int64)
            if self.escape:
                widths[np.frombuffer(raw, np.uint8) == 32] = 3
                text = text.replace(" ", MARK)
            lead = 3 if self.prefix else 0
            ends = np.concatenate([[0], lead + np.concatenate([[0], np.cumsum(widths)])])
            return (MARK if self.prefix else "") + text, ends, np.concatenate([[0], np.arange(len(raw) + 1)])
        return self._normalise_by_map(raw)

    def _normalise_by_map(self, raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        steps, at = [], 0  # (replacement, start, end)
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            if hit is None:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                hit = n, raw[at : at + n]
            steps.append((hit[1], at, at + hit[0]))
            at += hit[0]
        space = MARK.encode() if self.escape else b" "
        if self.squeeze:
            while steps and not steps[0][0].strip(b" "):
                steps.pop(0)
        if not steps:
            return "", np.zeros(1, np.int64), np.array([len(raw)] if raw else [0])
        out, ends, sources = bytearray(), [0], [steps[0][1]]
        if self.prefix:
            out += space
            ends.append(len(out))
            sources.append(steps[0][1])
        after_space = self.squeeze
        for new, start, end in steps:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                out += new.replace(b" ", space)
                after_space = self.squeeze and new.endswith(b" ")
            sources[-1] = start if not new else sources[-1]
            if new:
                ends.append(len(out))
                sources.append(end)
        if self.squeeze:
            while out.endswith(space) and len(out) >= len(space):
                del out[-len(space) :]
            while len(ends) > 1 and ends[-2] >= len(out):
                ends.pop()
                sources.pop()
            ends[-1] = min(ends[-1], len(out))
        return out.decode("utf-8"), np.array(ends), np.array(sources)

    # -- encoding ---------------------------------------------------------

    def _merge(self, word: str) -> bytes:
        """The pieces of one part as int64 numbers: the length in normalised bytes, then 32 bits of id."""
        symbols = self._merge_short(word) if len(word) <= 48 else self._merge_long(word)
        pieces, out = self.pieces, array("q")
        for s in symbols:
            found = pieces.get(s)
            if found is not None:
                out.append(found)
                continue
            raw = s.encode("utf-8")
            if self.byte_ids:
                out.extend([self.byte_ids[b] for b in raw])
                out[-1] += len(raw) << 32
            else:
                out.append(self.unknown + (len(raw) << 32))
        return out.tobytes()

    def _merge_short(self, word: str) -> list[str]:
        """Merges by a plain list of the pairs' costs; the first least one is the leftmost best pair."""
        cost, none = self.costs.get, float("inf")
        symbols = list(word)
        pairs = [cost(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = cost(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = cost(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merge_long(self, word: str) -> list[str]:
        """The same with a queue, for parts that a list would make quadratic."""
        costs = self.costs
        symbols = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n)) + [-1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                joined = symbols[left] + symbols[right]
                found = costs.get(joined)
                if found is not None:
                    heapq.heappush(queue, (found, left, right, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, joined = heapq.heappop(queue)
            if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each piece's first byte and end in the original UTF-8 text."""
        even, ends, sources = self.normalise(text)
        known, parts = self.known, self.parts.findall(even)
        found = list(map(known.get, parts))
        if None in found:
            for k, part in enumerate(parts):
                if found[k] is None:
                    # A word may come twice in a text.
                    found[k] = known.get(part) or self._merge(part)
                    if len(part) < 200:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[part] = found[k]
        both = np.frombuffer(b"".join(found), np.int64)
        ids, sizes = both.astype(np.int32), both >> 32
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = sources[np.searchsorted(ends, bounds, "right") - 1].astype(np.int32)
        return ids, at[:-1], at[1:]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        listed = ids.tolist()
        out = list(map(self.plain.__getitem__, listed))
        if self.special[ids].any():
            out = self._with_bytes(listed, out)
        if self.prefix or self.squeeze:
            # The space mark that encoding put in front goes, from the first piece that shows anything.
            k = 0
            while k < len(listed) and listed[k] in self.control:
                k += 1
            if k < len(listed) and listed[k] not in self.byte_of and listed[k] != self.unknown and self.names[listed[k]].startswith(MARK):
                out[k] = out[k][1:]
        return "".join(out)

    def _with_bytes(self, ids: list[int], out: list[str]) -> list[str]:
        run, start = bytearray(), 0
        for k, i in enumerate([*ids, -1]):
            if i in self.byte_of:
                start = start if run else k
                run.append(self.byte_of[i])
                out[k] = ""
            elif run:
                out[start] = _utf8(bytes(run))
                run = bytearray()
        return out


def _utf8(raw: bytes) -> str:
    """Decodes; each byte that begins no whole character is one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_and_decode(docs: DataFrame, model_path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of the whole text of every row of ``docs`` (doc_id, text).

    ``starts`` and ``ends`` are byte offsets in the original UTF-8 text; a
    character of several byte pieces belongs to the last of them.  No begin or
    end ids.  A null or empty text has no ids and decodes to "".  doc_id is
    passed through, nulls and repeats too; other columns are not looked at.
    ``model_path`` is read on the executors.
    """

    def run(batches):
        model = load(model_path)
        for batch in slices(batches, rows=128, chars=500_000):
            ids, starts, ends, texts = [], [], [], []
            for text in batch.column("text").to_pylist():
                own, begin, end = model.encode(text)
                ids.append(own)
                starts.append(begin)
                ends.append(end)
                texts.append(model.decode(own) if decode else None)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(texts, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")
