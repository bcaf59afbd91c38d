"""Token ids of whole texts, by the tokenizers library with a bounded cache of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.common import as_bytes

#: Bytes of words met twice, of words met once lately (two turns of that) and what an entry takes beside its characters.
MOST_KNOWN, MOST_NEW, ENTRY = 40 << 20, 20 << 20, 170
#: Unknown words are encoded so many at a time, joined.
JOINED = 128
#: Bytes of text that are cut at once.
CUT = 4 << 20
_SPACE, _MARK, _LETTER = 1, 2, 4
#: Kinds of bytes, as a translation table.
_KIND = bytes(_SPACE if c in b"\t\n\x0b\x0c\r " else _MARK if c in b",.;:!?" else _LETTER if chr(c).isalnum() and c < 128 else 0 for c in range(256))
#: Bytes that are or may begin white space that is not cut at.
_SUSPECTS = bytes([*range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3])
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level BPE with the usual word pattern never merges across the start of a run of white space, nor
    from a letter or digit to a mark before white space. So texts are cut there, a run stays with the word
    behind it, and equal units are encoded once and remembered. Texts with white space beyond ASCII or a
    special token's string go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[k for t, k in names.items() if t[:1] == "\u0120"]] = True  # the byte-level sign for a space
        self.feed = np.zeros(len(self.spaced), bool)
        self.feed[np.frombuffer(self._whole(b"\n"), "<u4")] = True
        self.forget()

    def forget(self) -> None:
        """Drop the remembered units."""
        self.known: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.known_size = self.new_size = 0

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        return self._batch([t.encode("utf-8", "replace") for t in texts])

    def rows(self, ids, texts) -> Iterator[tuple]:
        """(id, token ids) of each row of an Arrow column of UTF-8 texts, about CUT bytes at a time."""
        keys, held, size = [], [], 0
        for key, text in zip(ids, texts):
            keys.append(key), held.append(text.as_py())
            size += len(held[-1])
            if size >= CUT:
                yield from zip(keys, self._batch(held))
                keys, held, size = [], [], 0
        yield from zip(keys, self._batch(held))

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        odd = {}
        for k, t in enumerate(texts):
            if any(s in t for s in self.special) or len(t) > len(t.translate(None, _SUSPECTS)) and _OTHER_SPACE.search(t.decode("utf-8", "replace")):
                odd[k] = self._whole(t)
        plain = [b"" if k in odd else t for k, t in enumerate(texts)] if odd else texts
        out = []
        for part in _parts(plain):
            out += self._cut(part)
        for k, ids in odd.items():
            out[k] = ids
        return out

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, from its units' ids."""
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.r_[0, ends[:-1]]
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        space = kind == _SPACE
        first = space.copy()
        first[1:] &= ~space[:-1]
        mark = np.flatnonzero(kind == _MARK)
        follows = np.append(space, True)[mark + 1]
        at_end = np.zeros(len(data) + 1, bool)
        at_end[ends] = True
        mark = mark[(follows | at_end[mark + 1]) & (mark > 0) & (kind[mark - 1] == _LETTER)]
        first[mark] = True
        first[begins[begins < len(data)]] = True
        start = np.flatnonzero(first)
        offsets = np.append(start, len(data)).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._look_up(as_bytes(units.dictionary))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, where = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        code = units.indices.to_numpy()
        size = size[code]
        to = np.cumsum(size)
        flat = flat[np.repeat(where[code] - (to - size), size) + np.arange(to[-1])]
        edge = np.r_[0, to][np.searchsorted(start, np.r_[begins, len(data)])]
        return [flat[a:b].tobytes() for a, b in zip(edge.tolist(), edge[1:].tolist())]

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        """Ids of different units. Those met again move from the new ones to the known ones while there is room."""
        ids = list(map(self.known.get, units))
        if None not in ids:
            return ids
        missing = [k for k, v in enumerate(ids) if v is None]
        need, room = [], self.known_size < MOST_KNOWN
        for k in missing:
            u = units[k]
            v = self.new.get(u) or self.older.get(u)
            if v is None:
                need.append(u)
                continue
            ids[k] = v
            if room:
                self.known[u] = v
                self.known_size += ENTRY + len(u) + len(v)
            else:
                self.new[u] = v
        found = self._encode(need)
        for k in missing:
            if ids[k] is None:
                ids[k] = found[units[k]]
        self.new.update(found)
        self.new_size += ENTRY * len(found) + sum(map(len, need)) + sum(map(len, found.values()))
        if self.new_size > MOST_NEW:
            self.new, self.older, self.new_size = {}, self.new, 0
        return ids

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each unit. Units behind a single space or line feed are joined; the tokens that begin with one cut the ids again."""
        spaced, fed, single = [], [], []
        for u in units:
            (single if len(u) < 2 or u[1] < 33 else spaced if u[0] == 32 else fed if u[0] == 10 else single).append(u)
        out: dict[bytes, bytes] = {}
        for some, first in ((spaced, self.spaced), (fed, self.feed)):
            for k in range(0, len(some), JOINED):
                group = some[k : k + JOINED]
                ids = np.array(self.library.encode_batch_fast([b"".join(group).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
                at = np.flatnonzero(first[ids])
                if len(at) != len(group):
                    single += group
                    continue
                raw, cuts = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
                out.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        for u in single:
            out[u] = self._whole(u)
        return out


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about CUT bytes; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CUT:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_OWN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, whose next task finds the common words; what it remembers is bounded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Encoder(path)
    return _OWN[path]
