"""Token ids of whole texts, with a bounded memory of words already encoded.

A text is cut before single spaces and line breaks. No rule of the two public vocabularies looks
across such a cut when no other white space is near it, so the ids of the parts, one after the other,
are those of the text. Texts with other white space are encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

from .text import slices

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit integers")

#: Bytes of words and their ids remembered per Python worker and vocabulary, and characters of a remembered word;
#: further words are encoded every time.
MEMORY = 64 << 20
LONGEST = 64
#: Bytes of text that are cut into words at a time.
STEP_BYTES = 2 << 20

#: White space of any kind but the space and the line feed.
_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_TAIL = re.compile(r"(.*[A-Za-z])([.,!?%&$*#:;]+)", re.S)
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.free = MEMORY
        #: The vocabulary with a normalizer lower-cases and drops white space.
        self.folds = self.tokenizer.normalizer is not None
        # A byte-level token is as long as the bytes it stands for, but for its mark of a word's end.
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.removesuffix("</w>") if self.folds else token)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[bytes]:
        """As ``whole``, for many short texts: one list of ids, cut by the tokens' lengths."""
        if len(texts) < 8:
            return self.whole(texts)
        got = self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids
        ids = np.array(got, "<u4")
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(t.encode()) for t in texts])
        cut = np.searchsorted(ends, wanted)
        if cut[-1] >= len(ends) or (ends[cut] != wanted).any():
            return self.whole(texts)
        data, last = ids.tobytes(), (4 * (cut + 1)).tolist()
        return [data[i:j] for i, j in zip([0, *last[:-1]], last)]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts not known; a known word before final punctuation is not encoded again."""
        known, new, got = self.known, [], {}
        for part in parts:
            tail = _TAIL.fullmatch(part)
            if tail and (a := known.get(tail[1])) is not None:
                end = self.tails.get(tail[2])
                if end is None:
                    end = self.whole([tail[2]])[0]
                    if len(tail[2]) <= 3:  # of nine characters, so these stay few
                        self.tails[tail[2]] = end
                got[part] = a + end
            else:
                new.append(part)
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            spaced = some if self.folds else [p if p[0] == "\n" else " " + p for p in some]
            got.update(zip(some, self._words(spaced)))
        for part, ids in got.items() if self.free > 0 else ():
            if len(part) <= LONGEST:
                known[part] = ids
                # Two objects and an entry of the table.
                self.free -= sys.getsizeof(part) + sys.getsizeof(ids) + 100
        return got

    def _cut(self, text: str) -> tuple[str, list[str]] | None:
        """The first word and the others, or None where the text must be encoded whole."""
        if not text or "<|" in text or _OTHER_SPACE.search(text):
            return None
        if self.folds:
            # Python alone gives a final sigma a form of its own.
            return "", (text if "\u03a3" in text else text.lower()).split()
        if text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS):
            return None
        head, *parts = text.replace("\n", " \n").split(" ")
        return head, parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; words that none has had before are encoded together."""
        get, cuts, missing = self.known.get, [], {}
        for text in texts:
            cut = self._cut(text)
            if cut is not None:
                ids = list(map(get, cut[1]))
                if None in ids:
                    missing.update((p, None) for p, i in zip(cut[1], ids) if i is None)
                cut = (*cut, ids)
            cuts.append(cut)
        learnt = self._learn(list(missing)) if missing else {}
        heads = iter(self.whole([t if c is None else c[0] for c, t in zip(cuts, texts) if c is None or c[0]]))
        out = []
        for cut in cuts:
            first = next(heads) if cut is None or cut[0] else b""
            if cut is not None:
                _, parts, ids = cut
                if None in ids:
                    ids = [learnt[p] if i is None else i for p, i in zip(parts, ids)]
                first += b"".join(ids)
            out.append(first)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoded(batch, encoder: Encoder):
    """(doc_id, ids) of the rows of an Arrow batch; a null text counts as empty."""
    for part in slices(batch, "text", STEP_BYTES):
        texts = [t or "" for t in part.column("text").to_pylist()]
        yield from zip(part.column("doc_id").to_pylist(), encoder.encode_all(texts))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
