"""Token ids of whole texts by the `tokenizers` library, with remembered pieces.

A byte-level or word-level BPE never merges across the boundaries its
pre-tokenizer cuts, so the ids of a text are the ids of its pieces laid end to
end. `Encoder` cuts a batch of texts at spaces with Arrow, cuts the distinct
chunks into pieces, asks the library once for each piece it doesn't remember and
lays the answers end to end with numpy. What is remembered are Arrow strings and
flat arrays; when there are too many, the half used last stays.
A text with characters or spacing for which this cut isn't known to be the
tokenizer's own goes to the library whole, so every text gets the library's
ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose class (letter, digit, space, other) every regex engine agrees on.
_SAFE = r"\n\x20-\x7e¡-©«-±´¶-¸»¿-ÿ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces of a chunk without line ends: fixed patterns of the two published vocabularies, over safe characters.
_PIECES = {
    "space": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+",
    "word": rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+",
}
#: Line ends keep the last of them apart if a word follows, which takes a look ahead.
_LINES = re.compile(_PIECES["space"] + r"|\s+(?!\S)|\s+")
#: Stands between pieces the library is asked for at once: no piece holds its token.
_BETWEEN = {"space": "\n", "word": " 7 "}
_ASKED = 2_000
#: Pieces remembered by one Python worker (about 50 bytes each).
REMEMBERED = 1_000_000
#: Text bytes encoded at a time.
BATCH_BYTES = 12 << 20


class Memory:
    """Answers for pieces: rows of numbers laid end to end."""

    def __init__(self, ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], empty: np.ndarray, most: int):
        self.ask, self.most, self.now = ask, most, 0
        self.pieces = pa.array([], pa.large_string())
        self.flat, self.size, self.used = empty, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(answers for distinct pieces laid end to end, rows of each)."""
        self.now += 1
        at = pc.index_in(pieces, value_set=self.pieces)
        if at.null_count:
            new = pieces.filter(pc.is_null(at))
            flat, size = self.ask(new.to_pylist())
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        at = np.asarray(at).astype(np.int64)
        self.used[at] = self.now
        answer = gathered(self.flat, np.cumsum(self.size) - self.size, self.size, at)
        if len(self.pieces) > self.most:
            late = np.sort(np.argsort(-self.used, kind="stable")[: max(self.most // 2, 1)])
            self.flat = gathered(self.flat, np.cumsum(self.size) - self.size, self.size, late)[0]
            self.pieces, self.size, self.used = self.pieces.take(pa.array(late)), self.size[late], self.used[late]
        return answer


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs number `at` of `flat` laid end to end, the size of each)."""
    many = size[at]
    ends = np.cumsum(many)
    where = np.repeat(begin[at] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    return flat[where], many


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.ids = Memory(self._ask, np.zeros(0, self.dtype), remembered)
        self.spans = Memory(self._ask_spans, np.zeros((0, 2), "<i4"), remembered)
        self.lane = None
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if spec["model"]["type"] == "BPE" and not spec.get("post_processor"):
            if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not norm:
                self.lane = "space"
            elif [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and before.get("type") == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed":
                self.lane = "word"
        special = "".join("|" + re.escape(t["content"]) for t in spec.get("added_tokens") or [])
        # in the byte-level lane a space must be followed by a word
        self.odd = f"[^{_SAFE}]{special}" + ("| [ \\n]| $" if self.lane == "space" else "")
        self.between = self.tokenizer.encode(_BETWEEN[self.lane], add_special_tokens=False).ids if self.lane else []

    def _ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of some pieces: many to a text, told apart by the token between them."""
        mark = _BETWEEN[self.lane]
        bare = mark.strip(" ")
        alone = np.fromiter((bare in p for p in pieces), bool, len(pieces))
        if len(self.between) != 1 or alone.all():
            return self._ask_listed(pieces)
        if alone.any():
            return self._ask_apart(pieces, alone)
        texts = [mark.join(pieces[i : i + _ASKED]) for i in range(0, len(pieces), _ASKED)]
        got = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.append(g, self.between[0]) for g in got])
        ends = np.flatnonzero(flat == self.between[0])
        if len(ends) != len(pieces):
            return self._ask_listed(pieces)
        return np.delete(flat, ends).astype(self.dtype), np.diff(ends, prepend=-1) - 1

    def _ask_apart(self, pieces: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that hold the mark are asked for as a list."""
        a, many_a = self._ask_listed([p for p, x in zip(pieces, alone) if x])
        b, many_b = self._ask([p for p, x in zip(pieces, alone) if not x])
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = np.arange(len(pieces))
        size = np.concatenate([many_a, many_b])
        return gathered(np.concatenate([a, b]), np.cumsum(size) - size, size, order)

    def _ask_listed(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode_batch([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(got.ids, self.dtype), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))

    def _ask_spans(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode_batch([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(got.offsets, "<i4").reshape(-1, 2), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, where each text's begin and the last ends); null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        odd = np.ones(n, bool) if self.lane is None else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        ids, bounds = (np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)) if odd.all() else self._laid(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        if not odd.any():
            return ids, bounds
        at = np.flatnonzero(odd)
        whole = self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        parts, last = [], 0
        counts = np.diff(bounds)
        for i, e in zip(at.tolist(), whole):
            parts += [ids[last : bounds[i]], np.array(e.ids, self.dtype)]
            last, counts[i] = bounds[i], len(e.ids)
        return np.concatenate([*parts, ids[last:]]), np.concatenate([[0], np.cumsum(counts)])

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(first chunk of each text and the end, code of each chunk, the distinct chunks)."""
        if self.lane == "word":
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        codes, words = coded.indices.to_numpy().copy(), coded.dictionary
        if self.lane == "space":  # all but the first chunk of a text begin with the space before them
            first, again = np.unique(codes[offsets[:-1]], return_inverse=True)
            codes[offsets[:-1]] = len(words) + again
            words = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string())), words.take(pa.array(first))])
        return offsets, codes, words

    def _cut(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces of all chunks, first piece of each chunk, number of its pieces)."""
        first, many = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        lines = pc.match_substring(chunks, "\n").to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(chunks.filter(pa.array(~lines)), f"({_PIECES[self.lane]})", "\\1\x01")
        lists = pc.split_pattern(marked, "\x01")  # an empty one ends each
        at = np.asarray(lists.offsets).astype(np.int64)
        real = np.ones(at[-1], bool)
        real[at[1:] - 1] = False
        pieces = lists.values.filter(pa.array(real))
        first[~lines], many[~lines] = at[:-1] - np.arange(len(at) - 1), np.diff(at) - 1
        if lines.any():
            parts = [_LINES.findall(c) for c in chunks.filter(pa.array(lines)).to_pylist()]
            many[lines] = np.fromiter(map(len, parts), np.int64, len(parts))
            first[lines] = len(pieces) + np.cumsum(many[lines]) - many[lines]
            pieces = pa.concat_arrays([pieces, pa.array([p for q in parts for p in q], pa.large_string())])
        return pieces, first, many

    def _answered(self, memory: Memory, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(answers for the pieces of distinct chunks laid end to end, where each chunk's begin, rows of each)."""
        pieces, first, many = self._cut(chunks)
        coded = pc.dictionary_encode(pieces)
        flat, size = memory.of(coded.dictionary)
        flat, size = gathered(flat, np.cumsum(size) - size, size, coded.indices.to_numpy().astype(np.int64))
        if flat.ndim == 2:  # places in a piece become places in its chunk
            length = pc.utf8_length(pieces).to_numpy().astype(np.int64)
            before = np.concatenate([[0], np.cumsum(length)])
            start = before[:-1] - np.repeat(before[first], many)[np.argsort(np.repeat(first, many), kind="stable")] if len(pieces) else before[:0]
            flat = flat + np.repeat(start, size)[:, None].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat, ends[first], ends[first + many] - ends[first]

    def _laid(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, codes, words = self._coded(texts)
        flat, begin, size = self._answered(self.ids, words)
        ids, many = gathered(flat, begin, size, codes)
        return ids, np.concatenate([[0], np.cumsum(many)])[offsets]

    def offsets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """((tokens, 2): start and end character of each token in its text, as the library gives them; where each text's begin)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = np.ones(n, bool) if self.lane != "space" else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        spans, bounds = np.zeros((0, 2), np.int64), np.zeros(n + 1, np.int64)
        if not odd.all():
            firsts, codes, words = self._coded(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
            flat, begin, size = self._answered(self.spans, words)
            length = pc.utf8_length(words).to_numpy().astype(np.int64)[codes]
            start = np.cumsum(length) - length
            start -= np.repeat(start[firsts[:-1]], np.diff(firsts))  # of each chunk in its text
            spans, many = gathered(flat, begin, size, codes)
            spans = spans + np.repeat(start, many)[:, None]
            ends = np.concatenate([[0], np.cumsum(many)])
            bounds = ends[firsts]
        if not odd.any():
            return spans, bounds
        parts, last, counts = [], 0, np.diff(bounds)
        at = np.flatnonzero(odd)
        for i, e in zip(at.tolist(), self.tokenizer.encode_batch(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
            parts += [spans[last : bounds[i]], np.array(e.offsets, np.int64).reshape(-1, 2)]
            last, counts[i] = bounds[i], len(e.offsets)
        return np.concatenate([*parts, spans[last:]]), np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary file."""
    return Encoder(path)
