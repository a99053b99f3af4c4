"""Whole-text tokenization with the tokenizers library, piece by piece."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

PIECES_KEPT, TOGETHER = 150_000, 1000
#: An empty text, or white space that is not one space or line feed between two other characters.
UNEVEN = "\\A\\z|\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\t\\x{b}-\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Before a space that stands alone between two other characters, a pre-token ends.
CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is cut only where the tokenizer's pre-tokens always end, so the
    pieces' ids joined are the ids of the whole text.  Pieces recur, and what the
    library said of one is kept while there is room.  ``kind`` is ``bytes`` for
    a byte-level vocabulary whose words carry their space, ``words`` for one with
    word ends that drops white space.  A text that holds one of the vocabulary's
    special strings goes to the library whole, which gives that string its own id.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = kind == "words"
        self.kept: dict[str, bytes] = {}  # by piece; a word of a byte-level vocabulary stands for itself after a space
        self.older: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        mark = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            mark[i] = name.endswith("</w>") if self.words else name.startswith("Ġ")
        self.mark = mark  # ends a pre-token, or starts one after a space

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        """This worker's encoder."""
        cache = worker_cache(f"{kind} {path}")
        if "encoder" not in cache:
            cache["encoder"] = cls(path, kind)
        return cache["encoder"]

    def pieces(self, texts: pa.StringArray) -> pa.ListArray:
        """Texts cut where pre-tokens end.

        Words drop white space, so any space or line feed will do.  Byte-level
        pieces are words that follow one space, or one line feed, which they
        keep; one line feed is put before the text.
        """
        if self.words:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, pieces: list[str]) -> None:
        """Ids of pieces that are not kept."""
        plain = [p for p in pieces if p.isalpha()]
        space = "" if self.words else " "
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([space + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.mark[ids])
            if len(at) == len(some):  # each word is one pre-token
                ends = at + 1 if self.words else np.r_[at[1:], len(ids)]
                data, start = ids.tobytes(), 0
                for p, e in zip(some, (ends * 4).tolist(), strict=True):
                    self.kept[p] = data[start:e]
                    start = e
        left = [p for p in pieces if p not in self.kept]
        self.kept.update(zip(left, self._library([p if p[:1] == "\n" else space + p for p in left]), strict=True))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, kept or asked for."""
        if len(self.kept) > PIECES_KEPT:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        out = list(map(kept.get, pieces))
        new = {p for p, v in zip(pieces, out, strict=True) if v is None}
        for p in new & older.keys():
            kept[p] = older[p]
        new -= kept.keys()
        # A letter's pre-token ends before a stop or comma.
        tails = [p for p in new if len(p) > 1 and p[-1] in ".," and p[-2].lower().isalpha()]
        new.difference_update(tails)
        new.update(p[:-1] for p in tails)
        stops = {".": b"", ",": b""} if not tails else dict(zip(".,", self._library([".", ","]), strict=True))
        self._ask(list(new - kept.keys()))
        for p in tails:
            kept[p] = kept[p[:-1]] + stops[p[-1]]
        return [kept[p] if v is None else v for p, v in zip(pieces, out, strict=True)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text; a null text is empty.

        Arrow numbers the pieces of all texts, each distinct one is looked up
        once, and numpy strings their ids together.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        whole = np.zeros(len(texts), bool)
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        odd = whole if self.words else whole | pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        cut = self.pieces(plain)
        numbered = cut.flatten().dictionary_encode()
        known = self._known(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        which = numbered.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        data = memoryview(pool[at].tobytes())
        words = cut.offsets.to_numpy()
        bounds = (np.r_[0, ends][words - words[0]] * 4).tolist()
        skip = 0 if self.words else 4  # the line feed put before
        return [self._asked(texts[i].as_py(), bool(whole[i])) if o else bytes(data[a + skip : z]) for i, (o, a, z) in enumerate(zip(odd.tolist(), bounds, bounds[1:], strict=False))]

    def _asked(self, text: str, whole: bool) -> bytes:
        """Ids of a text with special strings, whole, or with other white space: its parts are asked for as they are."""
        return b"".join(self._library([text] if whole else CUT.split(text)))
