"""Encoding of whole texts with the `tokenizers` library, memoised by piece.

A byte-level or word BPE never merges across a pre-token border.  The last
white space of a run always starts a new pre-token, and so does a full stop or
comma between a letter or digit and whatever is not punctuation.  A text can
therefore be cut there, and the ids of the pieces, each made by the library,
concatenate to the ids of the text.  Pieces repeat a lot, so their ids are kept
in a memo of two generations per Python worker: when the younger one is full it
becomes the older one, and what a text uses moves to the younger again.

Texts are tried at the finest cut first (`FINE`), then at blanks and line feeds
only, and those that allow neither go through the library in one call, as do
texts in which a special string of the vocabulary may stand: these get what the
library's default call gives.  A piece that would make a cut unsafe has `None`
in the memo.  If that is one that ends in a mark, the text is cut at the full
stops and commas after letters and digits only; such pieces' ids are in `odd`.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Pieces in one generation of a memo: some 30 MB.  A worker has two memos of two generations for a vocabulary.
MEMO_PIECES = 160_000
#: New pieces are encoded together, so many at a time.
BATCH_PIECES = 4096

_LETTERS = re.compile(r"[^\W\d_]+\Z").match
_SPACE = re.compile(r"\s").search
_PUNCTUATION = ("..", ",,", ".,", ",.")
#: Puts something before each full stop or comma that follows a letter or digit.
_AFTER_WORD = re.compile(r"[.,](?<=[^\W_].)").sub
_ENCODERS: dict = {}


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file `name` is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    `keeps_space`: whether the vocabulary has blanks and line feeds in its
    tokens (byte-level BPE) or drops them (word BPE).  `kept`: pieces in one
    generation of a memo, `MEMO_PIECES` by default.
    """

    def __init__(self, path: str, keeps_space: bool, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.kept = kept
        self.lead = " " if keeps_space else ""
        self.line = self.direct("\n")
        #: Words are encoded many at a time, joined by something that is one token of its own beside letters.
        self.joint = "\n" if keeps_space else " \x01 "
        self.joint_ids = np.frombuffer(self.direct(self.joint), "<u4")
        #: Whether an id ends a word; none if the vocabulary does not mark ends, or not every letter's end.
        self.ends = None if keeps_space else self._word_ends()
        #: How special strings begin.
        self.special = {token.content[:2] for token in self.library.get_added_tokens_decoder().values()}
        self.fine: list[dict[str, bytes | None]] = [{}, {}]
        self.coarse: list[dict[str, bytes | None]] = [{}, {}]
        #: Ids of pieces with marks, in two generations as well.
        self.odd: list[dict[str, bytes]] = [{}, {}]

    def direct(self, text: str) -> bytes:
        """The ids of one text by one call of the library."""
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[bytes]:
        """The ids of texts by calls of the library for many at a time."""
        out: list[bytes] = []
        for at in range(0, len(texts), BATCH_PIECES):
            made = self.library.encode_batch_fast(texts[at : at + BATCH_PIECES], add_special_tokens=False)
            out += [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in made)]
        return out

    def _word_ends(self) -> np.ndarray | None:
        from tokenizers.pre_tokenizers import ByteLevel

        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        if not suffix or any(byte + suffix not in vocabulary for byte in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _blank_joined(self, words: list[str]) -> list[bytes] | None:
        """The ids of words joined by blanks, cut at the ids that end a word; none if a word is not one pre-token."""
        out: list[bytes] = []
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                return None
            raw, start = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(raw[4 * start : 4 * end])
                start = end
        return out

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of pieces that are all letters, each with `lead` before it."""
        out: list[bytes] = []
        for at in range(0, len(words), BATCH_PIECES):
            some = words[at : at + BATCH_PIECES]
            if self.ends is not None and (made := self._blank_joined(some)) is not None:
                out += made
                continue
            if len(self.joint_ids) == 1:
                text = "".join(lead + word + self.joint for word in some)
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(ids == self.joint_ids[0])
                if len(ends) == len(some):
                    raw, start = ids.tobytes(), 0
                    for end in ends.tolist():
                        out.append(raw[4 * start : 4 * end])
                        start = end + 1
                    continue
            out += self.each([lead + word for word in some])
        return out

    def _learn(self, generations: list[dict], pieces: set[str], fine: bool) -> dict:
        """The younger generation, with all the pieces in it."""
        memo, older = generations
        new = [piece for piece in pieces if piece not in memo]
        memo.update((piece, older[piece]) for piece in new if piece in older)
        new = [piece for piece in new if piece not in older]
        words = [piece for piece in new if _LETTERS(piece)]
        if not fine:  # a word has the same ids at either cut
            for known in self.fine:
                memo.update((word, known[word]) for word in words if word in known)
            words = [word for word in words if word not in memo]
        memo.update(zip(words, self._words(words, self.lead), strict=True))
        opening = [piece for piece in new if piece[:1] == "\n" and _LETTERS(piece, 1)]
        if not self.lead:
            for known in (memo, *self.fine):
                memo.update([(piece, self.line + known[piece[1:]]) for piece in opening if known.get(piece[1:]) is not None])
            opening = [piece for piece in opening if piece not in memo]
        memo.update(zip(opening, (self.line + ids for ids in self._words([p[1:] for p in opening], "")), strict=True))
        rest: dict[str, str] = {}
        for piece in new:
            if piece in memo:
                continue
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or _SPACE(body) or fine and body not in (".", ",") and not body[-1].isalnum():
                memo[piece] = None
            else:
                rest[piece] = piece if piece[0] == "\n" or fine and piece[0] in ".," else self.lead + piece
        memo.update(zip(rest, self.each(list(rest.values())), strict=True))
        return memo

    def _marked(self, text: str, memo: dict) -> bytes | None:
        """The ids after the first piece, no cut being made at a full stop or comma after a mark; none if that cannot be."""
        if " ." in text or " ," in text:
            return None
        pieces = _AFTER_WORD(r" \g<0>", text.replace("\n", " \n")).split(" ")[1:]
        ids = list(map(memo.get, pieces))
        if len(self.odd[0]) > (self.kept or MEMO_PIECES) // 4:
            self.odd[:] = {}, self.odd[0]
        odd, older = self.odd
        new = []
        for piece in {piece for piece, known in zip(pieces, ids, strict=True) if known is None}:
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or _SPACE(body):
                return None
            if piece not in odd:
                if piece in older:
                    odd[piece] = older[piece]
                else:
                    new.append(piece)
        odd.update(zip(new, self.each([p if p[0] in "\n.," else self.lead + p for p in new]), strict=True))
        return b"".join([odd[piece] if known is None else known for piece, known in zip(pieces, ids, strict=True)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes | None] = [b"" if not text else None for text in texts]
        for i, text in enumerate(texts):
            if any(opening in text for opening in self.special):
                out[i] = self.direct(text)
        for generations, fine in ((self.fine, True), (self.coarse, False)):
            if len(generations[0]) > (self.kept or MEMO_PIECES):
                generations[:] = {}, generations[0]
            cut, new = [], set()
            for i, text in enumerate(texts):
                if out[i] is None and not (fine and any(x in text for x in _PUNCTUATION)):
                    spaced = text.replace("\n", " \n")
                    pieces = (spaced.replace(".", " .").replace(",", " ,") if fine else spaced).split(" ")
                    first = pieces.pop(0)  # no blank stood before it
                    if not first or fine and not first[-1].isalnum() or _SPACE(first):
                        continue
                    cut.append((i, first, pieces))
                    new.update(pieces)
            memo = self._learn(generations, new, fine)
            get = memo.__getitem__
            for (i, _, pieces), ids in zip(cut, self.each([first for _, first, _ in cut]), strict=True):
                try:
                    out[i] = ids + b"".join(map(get, pieces))
                except TypeError:  # a piece that allows no cut here
                    if fine and (rest := self._marked(texts[i], memo)) is not None:
                        out[i] = ids + rest
        left = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(left), 16):  # long texts among them: few at a time
            for i, ids in zip(left[at : at + 16], self.each([texts[i] for i in left[at : at + 16]]), strict=True):
                out[i] = ids
        return out


def encoder(path: str, keeps_space: bool, kept: int | None = None) -> Encoder:
    """The worker's encoder for the vocabulary at `path`, made once."""
    if (key := (path, keeps_space, kept)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_space, kept)
    return _ENCODERS[key]
