"""Tokenizers inside Spark tasks.

A public vocabulary is slow per character, and most words of a corpus repeat. A text is
therefore cut where the pre-tokenizer is sure to cut as well (before a blank or line feed
that follows a non-blank), each distinct unit is encoded once per Python worker by the
tokenizer library, and the ids of a text are those of its units in order. Arrow splits a batch,
numbers its distinct units and lays their ids out, so Python looks at a distinct unit once a batch.
Units over MAX_UNIT characters are encoded as they are and not kept. A text that holds one of
the vocabulary's added tokens (such as an end-of-text mark) goes to the library as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kbspark.llm.common import held_by_worker, text_batches

MAX_UNIT = 64
CACHE_UNITS = 800_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A word of Latin letters, maybe with one mark behind it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch
#: White space other than blanks and line feeds; runs of white space; where the first unit of a text ends.
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_RUNS = ("  ", "\n\n", " \n", "\n ")
_END = re.compile(r"[ \n]").search


def default_path(name: str) -> str:
    """Place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Ids of whole texts by an encoder of short units.

    encode_units: list of strings -> list of id lists, for any strings.
    encode_words: the same for words of Latin letters alone, maybe with a blank in front, if there is a shorter way.
    blanks_matter: False if white space never shows in the ids (it only separates words).
    lower: the tokenizer takes lower case of each character first.
    added: the vocabulary's added tokens.
    """

    def __init__(self, encode_units: Callable, vocab_size: int, blanks_matter: bool, encode_words: Callable | None = None, lower: bool = False, added: tuple[str, ...] = ()):
        self.encode_units, self.encode_words = encode_units, encode_words or encode_units
        self.vocab_size, self.blanks_matter, self.lower = vocab_size, blanks_matter, lower
        self.added = added
        self.code = "H" if vocab_size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        #: Ids of units behind one blank (or with the line feed before them), and of the others.
        self.inner: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _whole(self, text: str) -> bool:
        """Whether the library has to see the text as it is: it holds an added token, as it stands or in lower case."""
        return any(x in text for x in self.added) or (self.lower and "<" in text and any(x in text.lower() for x in self.added))

    def _plain_spaces(self, text: str) -> bool:
        """Whether only single blanks and line feeds stand between words and none at the ends."""
        return text[:1] not in ("", " ", "\n") and text[-1] not in " \n" and not any(x in text for x in _RUNS) and not _OTHER_SPACE(text)

    def _learn(self, units: list[str], known: dict[str, bytes], behind_blank: bool) -> dict[str, bytes]:
        """Encode distinct units that are not known yet; long ones are returned, not kept.

        A word with one mark behind it is the word and the mark, which pre-tokenizers always part.
        """
        words, marked, others, code, long = {}, [], [], self.code, {}
        for u in units:
            found = _WORD(u)
            # the short way takes letters as they are; a unit with a capital sigma still has its capitals here
            if found is None or (self.lower and not u.islower()):
                others.append(u)
            else:
                word, mark = found.groups()
                if mark:
                    marked.append((u, word, mark))
                if not mark or word not in known:
                    words[word] = None
        front = " " if behind_blank else ""
        for new, encode, texts in ((list(words), self.encode_words, None), (others, self.encode_units, [u if u[0] == "\n" else front + u for u in others])):
            if new:
                for u, ids in zip(new, encode([front + u for u in new] if texts is None else texts), strict=True):
                    (known if len(u) <= MAX_UNIT else long)[u] = array(code, ids).tobytes()
        if marked:
            marks = {c: array(code, self.encode_units([c])[0]).tobytes() for c in {c for *_, c in marked}}
            for u, word, mark in marked:
                (known if len(u) <= MAX_UNIT else long)[u] = (known.get(word) or long[word]) + marks[mark]
        return long

    def _look_up(self, units: list[str], known: dict[str, bytes], behind_blank: bool) -> list[bytes]:
        """Ids of distinct units."""
        if len(known) > CACHE_UNITS:
            known.clear()
        known[""] = b""
        if self.lower:
            units = [u if "Σ" in u else u.lower() for u in units]  # the lower case of a sigma depends on its place
        ids = list(map(known.get, units))
        places = [i for i, x in enumerate(ids) if x is None]
        if places:
            long = self._learn(list(dict.fromkeys([units[i] for i in places])), known, behind_blank)
            for i in places:
                u = units[i]
                ids[i] = long[u] if u in long else known[u]
        return ids

    def _laid_out(self, texts: list[str], known: dict[str, bytes], behind_blank: bool) -> list[bytes]:
        """Ids of texts whose units stand between single blanks."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.values.dictionary_encode()
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known, behind_blank)
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        offsets, data = (np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in zip(taken.buffers()[1:], (np.int64, np.uint8), strict=True))
        ends, data = offsets[split.offsets.to_numpy()].tolist(), memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of `dtype`."""
        out = [b""] * len(texts)
        for start, end in text_batches(texts, 4_000_000):
            regular, firsts, rests = [], [], []
            for i in range(start, end):
                t = texts[i]
                if not t:
                    continue
                if self._whole(t):
                    out[i] = array(self.code, self.encode_units([t])[0]).tobytes()
                elif not self.blanks_matter:
                    regular.append(i)
                    rests.append(t.replace("\n", " "))
                elif self._plain_spaces(t):
                    regular.append(i)
                    at = _END(t)
                    at = at.start() if at else len(t)
                    firsts.append(t[:at])
                    rests.append(t[at:].replace("\n", " \n")[1:])
                else:
                    out[i] = b"".join(self._in_order(_CUT.split(t), self.plain, False))
            if regular and self.blanks_matter:
                first = self._in_order(firsts, self.plain, False)
                for i, a, b in zip(regular, first, self._laid_out(rests, self.inner, True), strict=True):
                    out[i] = a + b
            elif regular:
                for i, ids in zip(regular, self._laid_out(rests, self.plain, False), strict=True):
                    out[i] = ids
        return out

    def _in_order(self, units: list[str], known: dict[str, bytes], behind_blank: bool) -> list[bytes]:
        """Ids of units, some of them equal."""
        of = list(dict.fromkeys(units))
        return list(map(dict(zip(of, self._look_up(of, known, behind_blank), strict=True)).__getitem__, units))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        return [np.frombuffer(ids, self.dtype) for ids in self.encode_bytes(texts)]


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 characters stand for themselves, the others follow from U+0100."""
    out, extra = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD):
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def hugging_face(path: str, blanks_matter: bool) -> UnitEncoder:
    """The encoder of a tokenizers JSON file of a byte-level vocabulary; its added tokens in a text are one id, as the library has it."""
    return held_by_worker((path, blanks_matter), lambda: _hugging_face(path, blanks_matter))


def _hugging_face(path: str, blanks_matter: bool) -> UnitEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode_units(units):
        return [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    # a word of letters is one pre-token, so the model alone encodes its byte characters
    lower = tokenizer.encode("A", add_special_tokens=False).ids == tokenizer.encode("a", add_special_tokens=False).ids
    mapping, tokenize = dict(enumerate(byte_characters())), tokenizer.model.tokenize

    def characters(word: str) -> str:
        if word.isascii():  # letters stand for themselves
            return "Ġ" + word[1:] if word[0] == " " else word
        return word.encode("utf-8").decode("latin-1").translate(mapping)

    def encode_words(words):
        return [[t.id for t in tokenize(characters(w))] for w in words]

    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return UnitEncoder(encode_units, tokenizer.get_vocab_size(), blanks_matter, encode_words, lower, added)
