"""Byte-level BPE encoding of many texts by the tokenizers library.

Words repeat, so a task encodes each distinct piece once and looks the rest up. The
vocabulary's pattern never joins a word to the white space after it, nor a letter or digit
to punctuation after it, so a text may be cut there. Texts where that is not plain (white
space in a row, other alphabets, added tokens) are cut at white space only or not at all.
"""

from __future__ import annotations

import os
import re
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks a task remembers before it starts anew.
REMEMBERED = 300_000
_FINE, _COARSE = (".", ",", " ", "\n"), (" ", "\n")
_SPACE_RUN = re.compile(r"\s[ \n]")
#: Latin-1 bytes by kind: letter or digit, plain space, other space, point or comma, the rest.
_KINDS = bytes(
    ord("a") if c.isalnum() else ord(" ") if c in " \n" else ord("w") if c.isspace() or c in "\x1c\x1d\x1e\x1f"
    else ord(".") if c in ".," else ord("p")
    for c in map(chr, range(256))
)
_UNCLEAR = (b"  ", b"w ", b" .", b"w.", b"p.", b"..")
_UNCLEAR_PLAIN = tuple(pair for pair in _UNCLEAR if b"w" not in pair)


def _plain(text: str) -> bool:
    """Whether single spaces, points and commas all follow a word."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return False
    return not any(pair in kinds for pair in (_UNCLEAR if b"w" in kinds else _UNCLEAR_PLAIN))


def _symbols() -> np.ndarray:
    """How a byte-level vocabulary writes each byte; zeros, which part words, as spaces."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    found = np.zeros(256, "<u4")
    found[own] = own
    found[found == 0] = np.arange(256, 512 - len(own))
    found[0] = 32
    return found


_SYMBOLS = _symbols()
_HEADS = (chr(_SYMBOLS[32]), chr(_SYMBOLS[10]))
#: Marks that the pattern makes a word of their own after a word.
_MARKS = "!#$%&*"
_MARK_RUN = re.compile(f"[{_MARKS}]+")


def _as_symbols(chunks: list[str]) -> str:
    """The words of ``chunks`` in the vocabulary's symbols; a line feed is a word of its own."""
    raw = "\0".join(chunks).replace("\n", "\n\0").encode()
    return _MARK_RUN.sub(r" \g<0>", _SYMBOLS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le"))


def load(path: str, special_as_text: bool = False):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return found


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes lists of texts; holds at most ``REMEMBERED`` chunks beside one batch."""

    def __init__(self, path: str | None = None, special_as_text: bool = False):
        self._tokenizer = load(path or default_vocabulary(), special_as_text)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._firsts = {s[0] for s in self._special}
        self._as_text = special_as_text
        self._words = self._word_tokenizer()
        self._kept: dict = {}
        self._forget()

    def _word_tokenizer(self):
        """The same model on words that stand in its symbols already: no pattern, no places in the text. None: the
        vocabulary is not plainly byte-level."""
        from tokenizers import Tokenizer, pre_tokenizers

        own, split = self._tokenizer, self._tokenizer.pre_tokenizer
        plain = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        if not plain or own.normalizer is not None or own.post_processor is not None:
            return None
        if any(own.token_to_id(h) is None for h in _HEADS) or any(s.strip().isalpha() for s in self._special):
            return None
        words = Tokenizer(own.model)
        words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._heads = np.empty(0, np.int8)  # by id: 1 if its token begins with a space or line feed, 2 if not, 0 if not met
        return words

    def _firsts_of(self, ids: np.ndarray) -> np.ndarray:
        """Places of tokens that begin with a space or line feed."""
        if (most := int(ids.max(initial=-1))) >= len(self._heads):
            self._heads = np.concatenate([self._heads, np.zeros(most + 1 - len(self._heads), np.int8)])
        for k in np.unique(ids[self._heads[ids] == 0]).tolist():
            self._heads[k] = 1 if self._tokenizer.id_to_token(k).startswith(_HEADS) else 2
        return np.flatnonzero(self._heads[ids] == 1)

    def _forget(self) -> None:
        """Keep only the chunks that were met again since the last time."""
        old, ids, ends = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        if self._kept:
            again = np.flatnonzero(self._kept["uses"] > 1)
            if len(again) < REMEMBERED // 2:
                known = list(self._kept["chunks"])
                old.update((known[k], at) for at, k in enumerate(again.tolist()))
                ids, counts = self._gather(again)
                ends = np.concatenate([[0], np.cumsum(counts)])
        self._kept |= {"chunks": old, "ids": ids, "ends": ends, "uses": np.zeros(len(old), np.int64)}

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``codes`` and their numbers."""
        ends = self._kept["ends"]
        starts, lengths = ends[codes], ends[codes + 1] - ends[codes]
        shift = starts - np.cumsum(lengths) + lengths
        return self._kept["ids"][np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths

    def _cuts(self, text: str) -> tuple[str, ...] | None:
        """Marks before which the text may be cut; None: it must be encoded whole."""
        if not text or "\0" in text:
            return None
        if not self._as_text and any(c in text for c in self._firsts) and any(s in text for s in self._special):
            return None
        if _plain(text):
            return _FINE
        return None if _SPACE_RUN.search(text) else _COARSE

    def _codes(self, chunks: list[str]) -> np.ndarray:
        """Numbers of distinct ``chunks``; those met for the first time are encoded."""
        known = self._kept["chunks"]
        codes = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh = [chunks[k] for k in new.tolist()]
            codes[new] = np.arange(len(known), len(known) + len(fresh))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self._learn(fresh)
        return codes

    def _learn(self, fresh: list[str]) -> None:
        """Encode chunks, a thousand at once. Those of a space or line feed, letters and perhaps marks are encoded as
        one text of words, where a chunk begins with the only token that begins with its space or line feed."""
        kept = self._kept
        plain = [self._words is not None and c[:1] in " \n" and c[1:].rstrip(_MARKS).isalpha() for c in fresh]
        ids, counts = [], []
        for wanted in (True, False):
            own = list(compress(fresh, plain if wanted else map(not_, plain)))
            groups = [own[at : at + 1000] for at in range(0, len(own), 1000)]
            if wanted:
                texts = [_as_symbols(g) for g in groups]
                found = self._words.encode_batch_fast(texts, add_special_tokens=False) if texts else []
                ids += [np.array(e.ids, np.int32) for e in found]
                firsts = map(self._firsts_of, ids)
                counts += [np.diff(f, append=len(one)) for f, one in zip(firsts, ids, strict=True)]
            else:
                found = self._tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
                ids += [np.array(e.ids, np.int32) for e in found]
                counts += [
                    np.bincount(np.array(e.word_ids, np.int64), minlength=len(g)) for e, g in zip(found, groups, strict=True)
                ]
        # back from the order of encoding to that of the chunks
        order = np.argsort(~np.array(plain, bool), kind="stable")
        lengths = np.concatenate([np.empty(0, np.int64), *counts])
        starts = np.empty(len(fresh), np.int64)
        starts[order] = len(kept["ids"]) + np.cumsum(lengths) - lengths
        sizes = np.empty(len(fresh), np.int64)
        sizes[order] = lengths
        flat = np.concatenate([kept["ids"], *ids])
        shift = starts - np.cumsum(sizes) + sizes
        new = flat[np.repeat(shift, sizes) + np.arange(sizes.sum())]
        kept["ids"] = np.concatenate([kept["ids"], new])
        kept["ends"] = np.concatenate([kept["ends"], kept["ends"][-1] + np.cumsum(sizes)])
        kept["uses"] = np.concatenate([kept["uses"], np.zeros(len(fresh), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if len(self._kept["chunks"]) > REMEMBERED:
            self._forget()
        kinds = [self._cuts(t) for t in texts]
        order, pieces, sizes = [], [], []
        for marks in (_FINE, _COARSE):
            own = [k for k, kind in enumerate(kinds) if kind is marks]
            cut = pa.array([texts[k] for k in own], pa.large_string())
            for mark in marks:
                cut = pc.replace_substring(cut, mark, f"\0{mark}")
            cut = pc.split_pattern(cut, "\0")
            order += own
            pieces.append(cut.values)
            sizes.append(np.diff(cut.offsets.to_numpy()))
        # each distinct piece of the batch is looked up once
        coded = pa.chunked_array(pieces).combine_chunks().dictionary_encode()
        codes = self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = codes[coded.indices.to_numpy()]
        self._kept["uses"] += np.bincount(codes, minlength=len(self._kept["uses"]))
        flat, lengths = self._gather(codes)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum(np.concatenate(sizes))])]
        if len(order) == len(texts) == len(sizes[0]):
            return flat, np.diff(bounds)
        found = {k: flat[a:b] for k, a, b in zip(order, bounds, bounds[1:])}
        whole = [k for k, kind in enumerate(kinds) if kind is None]
        slow = self._tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)
        found |= {k: np.array(one.ids, np.int32) for k, one in zip(whole, slow, strict=True)}
        parts = [found[k] for k in range(len(texts))]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([np.empty(0, np.int32), *parts]), counts
