"""Cut texts where no byte-level BPE token can cross, so that each different chunk is encoded once.

The public byte-level tokenizers split a text by ``'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Before a single space that stands between two characters that are not white space, that pattern always starts a new match,
and what follows is matched as if the text began there. The same holds around a line break between two such characters,
and between an ASCII letter or digit and a punctuation mark. Encoding the chunks between such places one by one therefore
gives exactly the ids of the whole text (its special tokens hold letters between marks, and so no such place). Chunks are told apart by Arrow's dictionary encoding and put back by number.
"""

from __future__ import annotations

import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexspark.llm.shared import WORKER_CACHES, forget_others

_ADJACENT = re.compile(r"\s\s")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_PLAIN = re.compile(r" ?\S+")
#: One pre-token whatever the version of Unicode: letters of the Latin blocks, digits, or other ASCII marks.
_ONE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: One of these that no text holds marks the places of the cuts.
SEPARATORS = "\x1f\x1e\x1d\x1c\x01\x02\x03\x04"


class Chunks(NamedTuple):
    """Different chunks; for all chunks in order their numbers; for each text the end of its chunks (it has one at least)."""

    words: list[str]
    numbers: np.ndarray
    ends: np.ndarray


def free_separator(texts: list[str]) -> str | None:
    return next((c for c in SEPARATORS if not any(c in t for t in texts)), None)


def between(marked, separator: str) -> Chunks:
    """The chunks of texts (a list or an Arrow array) in which a separator marks the cuts."""
    parts = pc.split_pattern(marked if isinstance(marked, pa.Array) else pa.array(marked, pa.large_string()), separator)
    coded = parts.flatten().dictionary_encode()
    return Chunks(coded.dictionary.to_pylist(), coded.indices.to_numpy(), parts.offsets.to_numpy()[1:].astype(np.int64))


def text_chunks(texts: list[str]) -> Chunks:
    separator = free_separator(texts)
    if separator is None:
        return Chunks(texts, np.arange(len(texts)), np.arange(1, len(texts) + 1))
    line, space = f"{separator}\n{separator}", f"{separator} "
    marked = [_BOUNDARY.sub(separator, t) if _ADJACENT.search(t) else t.replace("\n", line).replace(" ", space) for t in texts]
    return between(pc.replace_substring_regex(pa.array(marked, pa.large_string()), "([A-Za-z0-9])([.,;:!?])", f"\\1{separator}\\2"), separator)


class ChunkCache:
    """Values of chunks, each computed once while it stays in the cache.

    ``compute`` maps a list of strings to a list of values. When the cache holds more than ``limit`` entries, those not asked
    for again just now are dropped, so its memory is bounded whatever the input.
    """

    LONG = 64

    def __init__(self, compute, limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.known: dict = {}
        WORKER_CACHES.append(self.known)

    def values(self, words: list[str]) -> list:
        forget_others(self.known)
        if len(self.known) > self.limit:
            again = {w: self.known[w] for w in words if w in self.known}
            self.known.clear()
            self.known.update(again)
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.compute(new)))
        out = [self.known[w] for w in words]
        for w in new:
            if len(w) > self.LONG:
                del self.known[w]
        return out


def gathered(values: list[bytes], chunks: Chunks, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The values of all chunks one after the other, and the end of each text in them."""
    flat = np.frombuffer(b"".join(values), kind)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    length = sizes[chunks.numbers]
    stops = np.cumsum(length)
    at = np.repeat((np.cumsum(sizes) - sizes)[chunks.numbers] - stops + length, length)
    at += np.arange(len(at))
    return flat[at], stops[chunks.ends - 1] if len(stops) else stops


def byte_alphabet() -> dict[str, str]:
    """Byte-level BPE writes bytes as printable characters; this maps each back to the character of its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): chr(b) for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + extra)] = chr(b)
            extra += 1
    return table


_ENCODERS: dict[str, ChunkCache] = {}


def id_encoder(path: str) -> ChunkCache:
    """This worker's cache of little-endian unsigned 32-bit ids for a tokenizers file."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        from lexspark.llm.shared import single_threaded_tokenizers

        single_threaded_tokenizers()
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda pieces: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        (line_break,) = encode(["\n"])

        model = tokenizer.model.tokenize
        shown = str.maketrans({byte: sign for sign, byte in byte_alphabet().items()})
        space = " ".translate(shown)

        def compute(pieces: list[str]) -> list[bytes]:
            """A chunk that is one pre-token goes to the model as it is. Of the others those without inner white space are
            encoded together with line breaks, which are tokens of their own, between them."""
            found: dict[str, bytes] = {}
            plain = []
            for p in pieces:
                if _ONE.fullmatch(p):  # no special token holds marks or letters alone
                    if p.isascii():  # of these bytes only the space is written as another character
                        written = space + p[1:] if p[0] == " " else p
                    else:
                        written = p.encode().decode("latin-1").translate(shown)
                    found[p] = array("I", [t.id for t in model(written)]).tobytes()
                elif len(line_break) == 1 and _PLAIN.fullmatch(p):
                    plain.append(p)
            groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
            for group, ids in zip(groups, encode(["\n" + "\n".join(g) + "\n" for g in groups])):
                cuts = np.flatnonzero(ids == line_break[0])
                if len(cuts) == len(group) + 1:
                    data, cuts = ids.tobytes(), (4 * cuts).tolist()
                    found.update((p, data[a + 4 : b]) for p, a, b in zip(group, cuts, cuts[1:]))
            rest = [p for p in pieces if p not in found]
            found.update(zip(rest, (x.tobytes() for x in encode(rest))))
            return [found[p] for p in pieces]

        _ENCODERS[path] = ChunkCache(compute)
    return _ENCODERS[path]


def encode_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, one after the other, as little-endian unsigned 32-bit integers, and the end of each text."""
    chunks = text_chunks(texts)
    return gathered(id_encoder(path).values(chunks.words), chunks)
