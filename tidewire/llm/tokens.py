"""Token ids by a public tokenizer file, word by word with a bounded memory of words met before.

Both vocabularies used here never join text across a blank that is followed by
a visible character, so a text may be cut there and its words encoded one by one.
Most words of a corpus repeat, which makes looking them up far cheaper than
encoding them again. New words of plain letters go to the library's model, others are encoded in one text, set apart by a special
token, on both sides of which the library begins anew. Texts for which this may not hold are encoded whole: those
with the text of a special token in them, or unusual white space. The tests hold the result against whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 1_000_000
TOGETHER = 512  # words encoded in one text
TRIED = ("a", "the", "word", "encode", "antidisestablishmentarianism", "xqzvwkj", "für", "señor", "ÉTÉ", "œuvre", "Æ")
# Byte-level vocabularies write a byte that is no visible Latin-1 character as one from 256 on, in order; line ends are left, as they are between words.
BYTE_LEVEL = np.arange(256, dtype="<u4")
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LEVEL[HIDDEN] = range(256, 256 + len(HIDDEN))
BYTE_LEVEL[10] = 10
# Latin letters alone, each of which stays one letter when it is made small.
is_plain = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
ID = attrgetter("id")
LONG_WORD = 24  # longer words hardly ever come again
# Marks after a letter; an apostrophe can belong to a word.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LONG_MARKS = 4  # longer runs of them stay with their word
MAX_ENDINGS = 10_000
TOGETHER_CHARS = 8_000_000  # characters of texts that are cut into words at a time
# White space other than blank and line end, and two of these together: such texts are encoded whole.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLE = ("  ", " \n", "\n ", "\n\n")


def is_odd(text: str) -> bool:
    """Whether white space meets white space or an end of the text, or is of an unusual kind."""
    return text[:1].isspace() or text[-1:].isspace() or any(d in text for d in DOUBLE) or any(c in text for c in OTHER_SPACE)


def ends_in_letter(word: str) -> bool:
    """Whether the last character is a letter and stays one letter when it is made small."""
    small = word[-1:].lower()
    return len(small) == 1 and small.isalpha()


class WordIds(dict):
    """Little-endian 32-bit ids of words, as bytes; holds at most ``MAX_WORDS`` and the new ones of one call, then forgets all others than those of that call.

    A word is stored without the blank before it; one that begins a line has
    the line end in front. Marks after a letter are apart from it, so ``word,`` is
    encoded as ``word`` and ``,``. Where case makes no difference, ASCII words share their lower-case form.
    A word of Latin letters alone is one piece to the library, and is handed to its model directly, its bytes written as
    byte-level vocabularies write them: ``piece`` is what the model wants in front of it, None if it does not give the same ids.
    """

    def __init__(self, tokenizer, lead: str, caseless: bool, special: tuple[str, int] | None):
        super().__init__()
        self.tokenizer, self.lead, self.caseless, self.special = tokenizer, lead, caseless, special
        self.endings: dict[str, bytes] = {}
        self.newline = self._encode("\n")
        self.model = tokenizer.model
        self.bare = all(self._ids_of("", w) == self._encode(w) for w in TRIED)
        self.piece = next((p for p in ("\u0120", "") if all(self._ids_of(p, w) == self._encode(lead + w) for w in TRIED)), None)

    def _ids_of(self, piece: str, word: str) -> bytes:
        return self._ids_of_all(piece, [word])[0]

    def _ids_of_all(self, piece: str, words: list[str]) -> list[bytes]:
        """The model's ids of plain words."""
        if self.caseless:
            words = [w.lower() for w in words]
        joined = "\n".join(words)
        if not joined.isascii():
            words = BYTE_LEVEL[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        numbers, ends, tokenize = [], [0], self.model.tokenize
        for word in words:
            numbers.extend(map(ID, tokenize(piece + word)))
            ends.append(4 * len(numbers))
        data = array("I", numbers).tobytes()
        return [data[i:j] for i, j in pairwise(ends)]

    def _encode(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def core(self, word: str) -> str:
        """The part of a word that has to be encoded."""
        if not word[-1:].isalpha():
            bare = word.rstrip(MARKS)
            if 0 < len(word) - len(bare) <= LONG_MARKS and ends_in_letter(bare):
                word = bare
        return word.lower() if self.caseless and word.isascii() else word

    def ending(self, marks: str) -> bytes:
        """The ids of marks at the end of a word."""
        found = self.endings.get(marks)
        if found is None:
            if len(self.endings) >= MAX_ENDINGS:
                self.endings.clear()
            found = self.endings[marks] = self._encode(marks)
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if self.special is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([self.lead + w for w in words], add_special_tokens=False)]
        text, number = self.special
        joined = text.join([self.lead + w for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == number)
        if len(ends) != len(words) - 1:
            raise ValueError("a word has the special token in it")
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)]

    def learn(self, words: list[str]) -> None:
        """Encode ``words``, none of which is known, together."""
        plain, lines, rest, marked = [], [], [], []
        seen: set[str] = set()
        for word in words:
            simple = self.piece is not None and is_plain(word)
            w = word if simple and not self.caseless else self.core(word)
            if w != word:
                marked.append((word, w))
            if w in seen or (w != word and w in self):
                continue
            seen.add(w)
            if simple or (self.piece is not None and is_plain(w)):
                plain.append(w)
            else:
                (lines if w[:1] == "\n" else rest).append(w)
        if plain:
            self.update(zip(plain, self._ids_of_all(self.piece, plain), strict=True))
        for w in lines:
            line = w[1:]
            self[w] = self.newline + (self._ids_of("", line) if self.bare and is_plain(line) else self._encode(line))
        for i in range(0, len(rest), TOGETHER):
            part = rest[i : i + TOGETHER]
            self.update(zip(part, self.encode_words(part), strict=True))
        for word, w in marked:
            self[word] = self[w] + self.ending(word[len(w) :]) if len(w) < len(word) else self[w]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different words."""
        found = list(map(self.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self) + 2 * len(new) > MAX_WORDS:  # go on with what these words have: the common ones are among them
            kept = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None} if 4 * len(words) < MAX_WORDS else {}
            self.clear()
            self.update(kept)
            self[""] = b""
            found = list(map(self.get, words))
            new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        self.learn(new)
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self[words[i]]
        for w in new:
            if len(w) > LONG_WORD:
                self.pop(w, None)
                self.pop(self.core(w), None)
        return found


class Encoder:
    """Ids of whole texts as bytes. ``spaced``: the vocabulary keeps blanks as part of the next word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.whole("a b") != self.whole("a") + self.whole("b")
        self.caseless = self.whole("Ab") == self.whole("ab")
        added = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.contents = [c.lower() if self.caseless else c for c, _ in added]
        self.ids = WordIds(self.tokenizer, " " if self.spaced else "", self.caseless, added[0] if added else None)
        self.ids[""] = b""

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def is_special(self, text: str) -> bool:
        """Whether the text of a special token is in this one."""
        text = text.lower() if self.caseless else text
        return any(c in text for c in self.contents)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out, start, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= TOGETHER_CHARS:
                out += self._encode_some(texts[start : i + 1])
                start, held = i + 1, 0
        return out + self._encode_some(texts[start:])

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: different words are encoded, and put together as the words follow each other."""
        if not texts:
            return []
        odd = [self.is_special(t) or (self.spaced and (not t or is_odd(t))) for t in texts]
        plain = ["" if o else t.replace("\n", " \n" if self.spaced else " ") for t, o in zip(texts, odd, strict=True)]
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        starts, found = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        words, places = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().copy()
        ids = self.ids.encode(words)
        for i, (text, start) in enumerate(zip(texts, starts[:-1].tolist(), strict=True)):
            if odd[i] or self.spaced:  # the whole text, or a first word that has no blank before it, in place of the first word
                ids.append(self.whole(text if odd[i] else words[places[start]]))
                places[start] = len(ids) - 1
        joined = pa.array(ids, pa.large_binary()).take(pa.array(places))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[starts].tolist()
        data = joined.buffers()[2]
        return [data[a:b].to_pybytes() if a < b else b"" for a, b in pairwise(ends)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; a bare name is looked up among the installed public files."""
    if path not in _ENCODERS:
        real = path
        if "/" not in path:
            import public_tokenizers

            real = public_tokenizers.path(path)
        _ENCODERS[path] = Encoder(real)
    return _ENCODERS[path]


def encoded(path: str, batches: Iterable[list[list]]) -> Iterator[tuple[list, list[bytes]]]:
    """(names, ids) of batches of names and texts. Short batches are put together, so that their common words are looked up once."""
    names, texts, held = [], [], 0
    for more_names, more_texts in batches:
        names += more_names
        texts += more_texts
        held += sum(map(len, more_texts))
        if held >= TOGETHER_CHARS:
            yield names, encoder(path).encode_all(texts)
            names, texts, held = [], [], 0
    if names:
        yield names, encoder(path).encode_all(texts)
