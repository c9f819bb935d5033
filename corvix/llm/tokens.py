"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import FORGET

#: What a byte is: white space, a letter, a mark or none of these, for ASCII.
_WHITE, _LETTER, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(9, 14), *range(28, 33)]] = _WHITE
_KIND[list(string.ascii_letters.encode())] = _LETTER
_KIND[list(string.punctuation.encode())] = _MARK
#: First bytes of other letters (U+00C0 to U+017F, but for two signs) and of other white space.
_LETTER_LEADS, _WHITE_LEADS = (0xC3, 0xC5), (0xC2, 0xE1, 0xE2, 0xE3)
_SIGNS = "\u00d7\u00f7"
_WHITES = [c.encode() for c in "\u0085\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Parts whose ids a worker keeps (about 200 bytes each); when there are more, those of over SHORT bytes go.
KEPT, SHORT = 1_100_000, 7
#: Bytes of texts worked on at once, if no text is longer, and new parts encoded as one text.
SLICE, TOGETHER = 4 << 20, 100


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where parts begin in texts that follow each other, each after a line feed; begins has these line feeds' places."""
    kind = _KIND[data]
    if data.max(initial=0) >= 0x80:
        lead = np.flatnonzero((data >= _LETTER_LEADS[0]) & (data <= _LETTER_LEADS[1]))
        kind[lead + 1] = _LETTER
        for sign in _SIGNS.encode().split(b"\xc3")[1:]:
            kind[lead[(data[lead] == 0xC3) & (data[lead + 1] == sign[0])] + 1] = 0
        lead = np.flatnonzero(np.isin(data, _WHITE_LEADS))
        first, second, third = (data.take(lead + k, mode="clip") for k in range(3))
        for white in _WHITES:
            own = lead[(first == white[0]) & (second == white[1]) & (len(white) == 2 or third == white[-1])]
            for k in range(len(white)):
                kind[own + k] = _WHITE
    cut = np.zeros(len(data), bool)
    white = kind == _WHITE
    cut[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~white[:-2] & ~white[2:]
    cut[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    cut[begins] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids, without special tokens.

    Byte-level BPE cuts a text by a pattern into pieces and encodes these one by one. A single white-space
    character between two others always begins a piece; a space then belongs to the next one, a line
    feed is a piece of its own. A mark after a letter begins one, too. So the parts between such places have the same
    ids alone as within the text, and those of a part are kept for its next occurrence. Many texts are cut at once, each
    after a line feed, which their ids then leave out, and each part that occurs in them is looked up once.
    New parts are encoded some hundreds at a time as one text, where what separates them is found again: the
    only token of a part after a space that starts with one is its first. Texts with an added token's
    name in them are encoded whole.
    """

    def __init__(self, definition: str, kept: int | None = None) -> None:
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        if '"use_regex":true' not in self.tokenizer.pre_tokenizer.__getstate__().decode().replace(" ", ""):
            raise ValueError("the tokenizer must be byte-level BPE")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._ids("\n")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, parts: list[str], spaced: bool) -> Iterator[bytes]:
        """Ids of parts without white space, each after a space or at the start of a line."""
        groups = [parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        texts = [f" {' '.join(g)}" if spaced else "\n".join(g) for g in groups]
        feed = np.frombuffer(self.feed, "<u4")[0]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            at = np.flatnonzero(self.starts[ids] if spaced else ids == feed)
            begins, ends = (at, np.append(at[1:], len(ids))) if spaced else (np.append(0, at + 1), np.append(at, len(ids)))
            if len(begins) != len(group):
                raise ValueError("parts can't be told apart")
            data = ids.tobytes()
            for a, b in zip((4 * begins).tolist(), (4 * ends).tolist()):
                yield data[a:b]

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts; those that begin with a line feed have its id first."""
        found: dict[bytes, bytes] = {}
        spaced, fed = {}, {}
        for part in new:
            text = part.decode()
            tail = text[1:]
            if text[0] in " \n" and tail.split() == [tail]:
                (spaced if text[0] == " " else fed)[part] = tail
            elif text[0] == "\n":
                found[part] = self.feed + self._ids(tail)
            else:
                found[part] = self._ids(text)
        found.update(zip(spaced, self._together(list(spaced.values()), True)))
        found.update(zip(fed, map(self.feed.__add__, self._together(list(fed.values()), False))))
        return found

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        ids = list(map(self.known.get, parts))
        new = [part for part, own in zip(parts, ids) if own is None]
        if new:
            found = self._learned(new)
            ids = [found[part] if own is None else own for part, own in zip(parts, ids)]
            most = self.kept or KEPT
            if len(self.known) > most:
                short = {k: v for k, v in self.known.items() if len(k) <= SHORT}
                self.known = short if len(short) <= most // 2 else {}
            self.known.update(found)
        return ids

    def _several(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a large_binary array without nulls."""
        joined = pc.binary_join_element_wise(pa.scalar(b"\n", texts.type), texts, pa.scalar(b"", texts.type))
        begins = np.frombuffer(joined.buffers()[1], np.int64, len(texts) + 1)
        data = joined.buffers()[2].slice(0, int(begins[-1]))
        cuts = _cuts(np.frombuffer(data, np.uint8), begins[:-1])
        parts = pa.Array.from_buffers(texts.type, len(cuts), [None, pa.py_buffer(np.append(cuts, begins[-1])), data]).dictionary_encode()
        ids = pa.array(self._looked_up(parts.dictionary.to_pylist()), texts.type).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(cuts) + 1)[np.searchsorted(cuts, begins)].tolist()
        out = memoryview(ids.buffers()[2])
        return (bytes(out[a + len(self.feed) : b]) for a, b in zip(ends, ends[1:]))

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null and empty ones have none."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_binary()), b"")
        sizes = pc.binary_length(column).to_numpy()
        at = 0
        while at < len(column):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + SLICE]), SLICE, "right")))
            some, whole = column.slice(at, end - at), {}
            for token in self.added:
                for k in np.flatnonzero(pc.match_substring(some, token).to_numpy(zero_copy_only=False)).tolist():
                    whole[k] = self._ids(some[k].as_py().decode())
            if whole:
                some = pc.if_else(pa.array([k in whole for k in range(len(some))]), pa.scalar(b"", some.type), some)
            for k, ids in enumerate(self._several(some)):
                yield whole.get(k, ids)
            at = end


@lru_cache(maxsize=1)
def encoder(definition: str, kept: int | None = None) -> Encoder:
    """The worker's encoder, with what it keeps; tasks that follow each other share it."""
    return Encoder(definition, kept)


FORGET.append(encoder.cache_clear)
