"""Token ids of whole texts by a byte-level BPE vocabulary, with a memo of pieces.

A byte-level tokenizer first cuts a text by the GPT-2 pattern, and merges never cross those cuts. Where two
neighbouring characters show that it cuts between them, whatever stands around, the text is cut here as well: letters,
digits and signs part from each other, an apostrophe from what it follows, and white space by the rules in CUTS. Each piece is
encoded once per task and remembered, so that a word costs no more with a comma behind it than without. Pieces are found and put
together as arrays, a few megabytes of texts at a time. Where the two characters don't tell, a piece is longer, never wrong. Texts
that hold a special token's string go to the tokenizer whole: as it does by itself, it becomes that token's id. So do all texts under another pattern.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa

from kinograph.llm.common import Memo

#: Bytes of the pieces that a task remembers, and of an entry beside its text.
MEMO_BYTES, ENTRY_BYTES = 48_000_000, 200
#: New pieces that are encoded as one text.
JOINED = 200
#: The pattern of GPT-2, which the cuts below hold for.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What is known of a byte's character: nothing, a letter, a digit, a sign, the apostrophe, the space, the line feed.
OTHER, LETTER, DIGIT, SIGN, QUOTE, SPACE, LINE = range(7)
SEEN, PARTED = (LETTER, DIGIT, SIGN, QUOTE), (LETTER, DIGIT, SIGN)
ALONE = {10: LINE, 32: SPACE, 39: QUOTE}
CLASSES = bytes(ALONE[c] if c in ALONE else OTHER if not 32 < c < 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN for c in range(256))
#: First bytes of characters of two bytes that are letters, U+00C0 to U+023F and U+0400 to U+047F, but for the signs of multiplication and division.
LEADS = bytes(c in (*range(0xC3, 0xC9), 0xD0, 0xD1) for c in range(256))
PAIRS = [(a, b) for a in range(32) for b in range(8)]
#: Whether a cut lies between bytes of two classes (8 times the first and the second). A letter, digit or sign begins a match of its own behind the others;
#: only an apostrophe may hold on to letters. So does white space behind what is seen, and what is seen behind a line feed.
BETWEEN = bytes(a in SEEN and b in (SPACE, LINE) or a == LINE and b in SEEN or a != b and a in PARTED and b in PARTED or a in (LETTER, DIGIT) and b == QUOTE for a, b in PAIRS)
#: Whether a cut lies before the first of them: the last character of a stretch of white space is matched by itself or with what follows.
BEFORE = bytes(a in (SPACE, LINE) and b in SEEN for a, b in PAIRS)
#: The characters that a byte-level vocabulary writes bytes as, by the library's rule: visible Latin-1 as it is, the rest from U+0100 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = "".join(chr(c) if c in VISIBLE else chr(256 + c - sum(v < c for v in VISIBLE)) for c in range(256))


def laid_out(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts one behind the other, and where each text's begin, with the end of all; null is an empty text."""
    texts = texts.fill_null("")
    _, offsets, held = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return held[bounds[0] : bounds[-1]].to_pybytes() if bounds[0] < bounds[-1] else b"", bounds - bounds[0]


def cut_texts(data: bytes, bounds: np.ndarray, known: bool, special: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start in texts that lie one behind the other, and which are a space and letters; if the pattern is not ``known``, a text is a piece."""
    cut, kinds = np.zeros(len(data) + 1, bool), np.frombuffer(bytearray(data.translate(CLASSES)), np.uint8)
    if known:
        values = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero(np.frombuffer(data.translate(LEADS), bool))
        lead = lead[(values[lead] != 0xC3) | (values[lead + 1] != 0x97) & (values[lead + 1] != 0xB7)]
        kinds[lead] = kinds[lead + 1] = LETTER
        pairs = kinds[:-1] * np.uint8(8) + kinds[1:]
        pairs[bounds[(bounds > 0) & (bounds < len(data))] - 1] = 0  # bytes of two texts
        pairs = pairs.tobytes()
        cut[1:-1] = np.frombuffer(pairs.translate(BETWEEN), bool)
        cut[:-2] |= np.frombuffer(pairs.translate(BEFORE), bool)
    cut[bounds] = True
    for s in map(str.encode, special):
        at = data.find(s)
        while at >= 0:
            text = np.searchsorted(bounds, at, "right") - 1
            a, b = bounds[text : text + 2]
            if at + len(s) <= b:
                cut[a + 1 : b] = False
            at = data.find(s, at + 1)
    starts = np.flatnonzero(cut[:-1])
    words = (kinds[starts] == SPACE) & known
    if len(starts):
        sizes = np.diff(starts, append=len(data))
        words &= (np.add.reduceat(kinds == LETTER, starts, dtype=np.int32) == sizes - 1) & (sizes > 1)
    return starts, words


def distinct(data: bytes, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each different piece once, and which of them every piece is."""
    ends = np.append(starts, len(data)).astype(np.int32)
    known = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return known.dictionary.to_numpy(zero_copy_only=False).tolist(), known.indices.to_numpy()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; made from a tokenizer file's JSON."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(MEMO_BYTES, ENTRY_BYTES)
        form = json.loads(tokenizer_json)
        first = form.get("pre_tokenizer") or {}
        self.model = Tokenizer(self.tokenizer.model)  # for words that are written as the vocabulary has them
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.cuts = not form.get("normalizer") and not form.get("truncation") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids whose token begins with a space
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(WRITTEN[32])]] = True

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], others: list[bytes]) -> None:
        """Remember pieces. ``words``, a space and letters each, are encoded many at a time, and parted where one begins."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        written = [codecs.charmap_decode(b"".join(g), "strict", WRITTEN)[0].replace(WRITTEN[32], f" {WRITTEN[32]}") for g in groups]
        for group, ids in zip(groups, self._encode(self.model, written)):
            starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(starts) != len(group):
                raise ValueError("the vocabulary merges across spaces")
            data = ids.tobytes()
            self.memo.update(zip(group, [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]))
        self.memo.update(zip(others, [ids.tobytes() for ids in self._encode(self.tokenizer, [p.decode() for p in others])]))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and where each text's begin, with the end of all; null is an empty text."""
        data, bounds = laid_out(texts.cast(pa.string()))
        if not data:
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int32)
        starts, words = cut_texts(data, bounds, self.cuts, self.special)
        every, which = distinct(data, starts)
        word = np.zeros(len(every), bool)
        word[which] = words
        memo = self.memo
        new = [p not in memo for p in every]
        if not memo.room(list(compress(every, new))):
            new = [True] * len(every)
        self._learn(list(compress(every, word & new)), list(compress(every, ~word & new)))
        found = [memo[p] for p in every]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        each = sizes[which]
        upto = np.append(np.int32(0), np.cumsum(each, dtype=np.int32))  # no more than bytes
        first = (np.cumsum(sizes, dtype=np.int32) - sizes)[which] - upto[:-1]
        ids = flat[np.repeat(first, each) + np.arange(upto[-1], dtype=np.int32)]
        return ids, upto[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, upto = self.encode_array(pa.array(texts, pa.string()))
        data, at = ids.tobytes(), [4 * i for i in upto.tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]
