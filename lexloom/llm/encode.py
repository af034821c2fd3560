"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

Byte-level and word-level BPE never merge across certain white space. Texts are cut only there, the pieces of a batch
that are not known yet go through the tokenizer in one call, and the ids of a text are the joined ids of its pieces;
`tests/llm` holds the result against the tokenizer on whole texts. Texts where a cut might not be safe, or that hold the
text of a special token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: Pieces after which a worker starts a new table and keeps of the old one what it still meets. About 200 bytes each.
KEPT_PIECES = 1_000_000

#: White space besides the blank and the newline.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIGN_SET = frozenset(_SIGNS)
#: The sign after the last Latin letter of those that are encoded by the merges alone.
_LATIN = 0x250
_RUNS = ("  ", "\n\n", " \n", "\n ")


class PieceEncoder:
    """encode(texts) -> the ids of each text as little-endian uint32 (or uint16) bytes."""

    def __init__(self, path: str, *, spaces: str):
        """spaces: `leading` if a word's ids depend on one blank before it (byte-level), `dropped` if white space only divides."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading = spaces == "leading"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        # a newline stands alone between words; where white space is dropped, a control sign between blanks does
        self.mark, self.joint = ("\n", "\n") if self.leading else ("\x01", " \x01 ")
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else -1
        self.lowers = self.tokenizer.encode("AÀ", add_special_tokens=False).ids == self.tokenizer.encode("aà", add_special_tokens=False).ids
        self.signs_apart = self._signs_apart()
        self.kept = KEPT_PIECES
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = None if self.leading or not self.lowers else self._without_patterns()
        self.bytes = self._byte_letters() if self.leading else None

    def _signs_apart(self) -> bool:
        """Whether the vocabulary's own pattern cuts between a letter and ASCII signs after it, whichever they are."""
        cut = self.tokenizer.pre_tokenizer
        if cut is None:
            return False
        ends = lambda letter, signs: any(b == len(letter) for _, (_, b) in cut.pre_tokenize_str(letter + signs))
        return all(ends(letter, signs) for letter in ("a", "\u00e9", "\u044f") for signs in (*_SIGNS, _SIGNS))

    def _ends_in_letter(self, core: str) -> bool:
        """Whether the last sign of what the normaliser makes of core is a letter, as far as it is one of the scripts tried."""
        if not core[-1:].isalpha() or core[-1] >= "\u0530":
            return False
        if core[-1] >= "\u0100" and self.tokenizer.normalizer is not None:
            core = self.tokenizer.normalizer.normalize_str(core)
        return core[-1:].isalpha()

    def _without_patterns(self):
        """The tokenizer without normaliser and split pattern, which lower-case letters do not need; None if it is built otherwise."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        parts = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        last = (parts.get("pretokenizers") or [parts])[-1]
        if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or last.get("use_regex"):
            return None
        plain = Tokenizer.from_str(self.tokenizer.to_str())
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def _byte_letters(self) -> dict[int, str] | None:
        """What the byte-level vocabulary writes for a blank and for Latin letters; None if it is built otherwise.

        A blank and letters are one piece to its pattern, so the merges alone give their ids.
        """
        from tokenizers import pre_tokenizers

        parts = json.loads(self.tokenizer.to_str())
        cut, model = parts["pre_tokenizer"] or {}, parts["model"]
        if parts["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            return None
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        write = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        return {c: write(chr(c))[0][0] for c in (32, *(c for c in range(_LATIN) if chr(c).isalpha()))}

    def _letter_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are a blank, or none, and Latin letters."""
        tokenize, table, code = self.tokenizer.model.tokenize, self.bytes, self.code
        return [array(code, [t.id for t in tokenize(self._text(p).translate(table))]).tobytes() for p in pieces]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str], tokenizer) -> list[bytes]:
        """Ids of pieces, many in one text: the mark between them is a token of its own that no piece holds."""
        if len(pieces) < 2:
            return self._ids(pieces)
        ids = np.array(tokenizer.encode_batch_fast([self.joint.join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) != len(pieces) - 1:  # a vocabulary in which the mark merges
            return self._ids(pieces)
        data, w = ids.tobytes(), self.kind.itemsize
        starts, ends = [0, *((ends + 1) * w).tolist()], [*(ends * w).tolist(), len(data)]
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces that are encoded alone; None if the text must stay whole."""
        if any(s in text for s in self.special):
            return None
        if not self.leading:
            if self.lowers:
                try:
                    text.encode("latin-1")
                    text = text.lower()  # here NFC changes nothing and each letter is lowered alone, as the tokenizer does
                except UnicodeEncodeError:
                    pass
            return text.replace("\n", " ").split(" ")
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or _OTHER_SPACE.search(text):
            return None
        # a blank belongs to the word that follows and is left out of its key; the first word of a line, which has none, is
        # marked by a NUL; newlines stand alone
        out: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = "\x00" + words[0]
            out += words
            out.append("\n")
        out.pop()
        return out

    def _text(self, key: str) -> str:
        """What a key of `known` stands for."""
        return key if not self.leading or key == "\n" else key[1:] if key[0] == "\x00" else " " + key

    def _learn(self, new: set[str]) -> None:
        """Adds pieces to those known. Where letters and ASCII signs after them never merge, `word.` is `word` and `.`."""
        known, mark, ended, todo = self.known, "\x00" if self.leading else "", [], []
        for p in new:
            if self.signs_apart and p[-1:] in _SIGN_SET:
                core = p.rstrip(_SIGNS)
                if self._ends_in_letter(core):
                    ended.append((p, core, mark + p[len(core) :]))
                    continue
            todo.append(p)
        todo += {x for _, *parts in ended for x in parts}.difference(known, new)
        if not self.leading:
            known[""] = b""
        odd = [p for p in todo if self.mark in p]
        known.update(zip(odd, self._ids(list(map(self._text, odd))), strict=True))
        if self.bytes:
            letters = [p for p in todo if (q := p.removeprefix("\x00")).isalpha() and (q.isascii() or ord(max(q)) < _LATIN)]
            known.update(zip(letters, self._letter_ids(letters), strict=True))
            rest = set(letters)
            kinds = ((self.tokenizer, [p for p in todo if p and p not in rest and self.mark not in p]),)
        elif self.plain:
            # words of lower-case Latin letters are as they are before and after normalising
            letters = [p for p in todo if p.isalpha() and p.islower() and max(p) < "\u0100"]
            rest = set(letters)
            kinds = ((self.plain, letters), (self.tokenizer, [p for p in todo if p and p not in rest and self.mark not in p]))
        else:
            kinds = ((self.tokenizer, [p for p in todo if p and self.mark not in p]),)
        for tokenizer, pieces in kinds:
            for a in range(0, len(pieces), 2000):
                part = pieces[a : a + 2000]
                known.update(zip(part, self._piece_ids(list(map(self._text, part)), tokenizer), strict=True))
        for p, core, signs in ended:
            known[p] = known[core] + known[signs]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = list(texts)
        cut = [self._pieces(t) if t else [] for t in texts]
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        known = self.known
        flat = list(chain.from_iterable(p for p in cut if p))
        ids = list(map(known.get, flat))
        at = [i for i, x in enumerate(ids) if x is None]
        if at:
            new = {flat[i] for i in at}
            again = [p for p in new if p in self.older]  # pieces that are used again move on, the others go
            known.update((p, self.older[p]) for p in again)
            self._learn(new.difference(again))
            for i in at:
                ids[i] = known[flat[i]]
        out, a = [], 0
        for t, pieces in zip(texts, cut, strict=True):
            n = len(pieces or ())
            out.append(self._ids([t])[0] if pieces is None else b"".join(ids[a : a + n]))
            a += n
        return out


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, spaces: str, kept: int = KEPT_PIECES) -> PieceEncoder:
    """The encoder of this process for a vocabulary file; there is one at a time, as its tables are large."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, spaces] = PieceEncoder(path, spaces=spaces)
    own = _ENCODERS[path, spaces]
    own.kept = kept
    return own


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
