"""Tokenizers with a bounded cache of distinct pre-tokens, one per Python worker."""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Entries of a worker's cache; it starts afresh beyond that (results do not change).
CACHE_ENTRIES = 600_000
#: Longer pre-tokens are not kept.
CACHE_CHARS = 64

_made: dict[tuple[str, str], object] = {}


def default_path(name: str) -> str:
    """A file of the public tokenizers; only its place is used, it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe(path: str) -> WordBpe:
    if ("word", path) not in _made:
        _made["word", path] = WordBpe(path)
    return _made["word", path]


def piece_counter(path: str) -> PieceCounter:
    if ("piece", path) not in _made:
        _made["piece", path] = PieceCounter(path)
    return _made["piece", path]


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordBpe:
    """Ids of a lower-casing word BPE (``tokenizers``), as little-endian unsigned 16-bit bytes.

    Its pre-tokens never cross white space and white space yields no ids, so a text's ids are
    those of its parts between blanks and line feeds.  Each distinct part is encoded once by
    the library and kept.  In Latin-1 texts, whose characters NFC leaves as they are, case
    folding and cutting final marks off a letter make more parts equal; both are what the
    library's normaliser and pre-tokeniser do themselves.  A part that is then one run of
    letters is one pre-token, which the library's model takes without those two steps.
    """

    #: Marks between a letter and a blank are a pre-token by themselves.
    _stop = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([!-/:-@\[-`{-~]+)(?= |$)")
    #: Bytes that the byte-level alphabet shows as another character than their own.
    _shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.cache: dict[str, bytes] = {"": b""}

    def _parts(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        if "<|" in text:  # special strings are matched before lower-casing
            return text.split(" ")
        return self._stop.sub(r" \1", text.lower()).split(" ")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out, rest, model = {}, [], self.tokenizer.model.tokenize
        for w in words:
            if w.isalpha() and max(w) < "\u0100" and w == w.lower():
                seen = w if w.isascii() else w.encode().decode("latin-1").translate(self._shown)
                out[w] = _packed([t.id for t in model(seen)])
            else:
                rest.append(w)
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                out[w] = _packed(e.ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        new = set().union(*parts).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache = {"": b""}
            new = set().union(*parts).difference(self.cache)
        known = self._learn(sorted(new))
        long = {w: b for w, b in known.items() if len(w) > CACHE_CHARS}
        self.cache.update(known if not long else {w: b for w, b in known.items() if w not in long})
        get = self.cache.__getitem__ if not long else lambda w: self.cache[w] if w in self.cache else long[w]
        return [b"".join(map(get, p)) for p in parts]


class PieceCounter:
    """Numbers of pieces of a ``sentencepiece`` model, summed over pre-tokens.

    A pre-token is a run of blanks with the run of other characters after it (or the blanks
    that end the text).  No piece of the model has a blank after another character, which is
    checked, so no merge crosses a pre-token's start and the counts add up exactly.
    """

    _runs = re.compile(" *[^ ]+| +$")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(n)):
            raise ValueError("a piece of this model crosses pre-tokens")
        self.cache: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Each without the one blank that the library puts before what it encodes."""
        if not text:
            return []
        text = text.replace("▁", " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in self._runs.findall(" " + text)]

    def learn(self, tokens) -> None:
        """Count the pieces of the pre-tokens that are not known yet, each once."""
        new = sorted(set(tokens).difference(self.cache))
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache = {}
            new = sorted(set(tokens))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            self.cache.update(zip(some, map(len, self.model.encode(some, num_threads=1))))
        self.cache[""] = 1  # the one blank that ends a text
