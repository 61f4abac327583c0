"""Token ids of whole texts with the tokenizers library, remembering ids of recurring words."""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in memory after it was thinned; it is when it holds twice as many.
REMEMBERED = 250_000
#: Bytes of a word that is remembered; longer ones hardly recur.
LONGEST = 64
#: Characters of text that are encoded together: a word recurs more often in more text.
CHARS = 4_000_000
#: New parts that are encoded as one text.
JOINED = 64
#: Letters beyond ASCII that normalising leaves letters (Latin, Cyrillic), all of two bytes in UTF-8.
_LETTERS = re.compile(
    "[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f\u0400-\u0481]")
_IS_LETTER = np.array([bool(_LETTERS.match(chr(i))) for i in range(0x800)])
_SPACES = " \t\n\v\f\r"
_WORD, _SPACE, _SIGN = 1, 2, 3
#: Bytes of white space beyond ASCII.
_WIDE_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
#: White space to Python only, and the one letter that grows a mark in lower case.
_UNSURE = "[\x1c-\x1f\u0130]"
_ENCODERS: dict = {}


def _kinds(words: Callable, signs: Callable) -> np.ndarray:
    """What each byte is; 0 for anything else and all beyond ASCII."""
    known = [_SPACE if c in _SPACES else _WORD if words(c) else _SIGN if signs(c) else 0
             for c in map(chr, range(0x80))]
    return np.array(known + [0] * 0x80, np.uint8)


#: By layout: a sign after a word character begins a token. The cuts of ByteLevel are known; those of
#: other patterns are taken to be at stops after letters.
_KINDS = {"leading": _kinds(str.isalnum, lambda c: not c.isspace()),
          "dropped": _kinds(str.isalpha, lambda c: c in ".,;:!?")}


class IdEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to encoding it as a whole.

    Where the tokenizer cuts texts at white space before it merges, parts between such cuts are
    encoded once and remembered; other tokenizers get whole texts. So does a text that holds an added
    token, such as a control string, which becomes that token's id as in the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.apart = "|".join([_UNSURE, *(_quoted(t) for t in added)])
        spec = json.loads(self.tokenizer.to_str())
        self.layout = self._layout(spec)
        #: Texts become lower case before they are cut, so ASCII words are remembered that way.
        self.one_case = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        #: The number of the batch that last held a word.
        self.used, self.batches = np.zeros(0, np.int64), 0
        self.mark, self.mark_in = (" \x01 ", "\x01") if self.layout == "dropped" else ("\n", "\n")
        self.mark_id = self._mark_id() if self.layout != "whole" else None

    def _mark_id(self) -> int | None:
        """The one id of the mark, if parts next to it keep their own ids."""
        near = [self.tokenizer.encode(t, add_special_tokens=False).ids
                for t in ("a", f"a{self.mark}b", "b")]
        middle = near[1][len(near[0]):len(near[1]) - len(near[2])]
        same = near[1] == near[0] + middle + near[2]
        return middle[0] if same and len(middle) == 1 else None

    @staticmethod
    def _layout(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        first = parts[0]
        if spec.get("normalizer") is None and first.get("type") == "ByteLevel" \
                and first.get("use_regex") and not first.get("add_prefix_space"):
            return "leading"
        if first.get("type") == "Split" and first.get("behavior") == "Removed" \
                and first.get("invert"):
            return "dropped"
        return "whole"

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([4 * len(x) for x in ids], dtype=np.int64).tolist()
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", ends[-1] // 4 if ends else 0)
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """As `_encode`, many parts in one text: a mark between them keeps them apart."""
        if self.mark_id is None:
            return self._encode(parts)
        out, plain = [b""] * len(parts), []
        for i, part in enumerate(parts):
            if self.mark_in in part or part[-1:].isspace():
                out[i] = self._encode([part])[0]
            else:
                plain.append(i)
        for begin in range(0, len(plain), JOINED * 64):
            own = plain[begin:begin + JOINED * 64]
            texts = [self.mark.join([parts[i] for i in own[k:k + JOINED]])
                     for k in range(0, len(own), JOINED)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            for x in ids:
                x.append(self.mark_id)
            flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", sum(map(len, ids)))
            ends = np.flatnonzero(flat == self.mark_id) * 4
            raw, start = flat.tobytes(), 0
            for i, end in zip(own, ends.tolist(), strict=True):
                out[i] = raw[start:end]
                start = end + 4
        return out

    def _learn(self, words: pa.Array) -> pa.Array:
        """Ids of each of the given distinct words. Those in memory are found by Arrow; Python and the
        library see new ones alone."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        learnt = pa.array(self._encode_parts(new.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        known = at >= 0
        self.batches += 1
        self.used[at[known]] = self.batches
        at[~known] = len(self.words) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, learnt]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        kept, learnt = new.filter(short), learnt.filter(short)
        self.words, self.ids = pa.concat_arrays([self.words, kept]), pa.concat_arrays([self.ids, learnt])
        self.used = np.concatenate([self.used, np.full(len(kept), self.batches)])
        if len(self.used) > 2 * REMEMBERED:
            last = pa.array(np.sort(np.argpartition(self.used, -REMEMBERED)[-REMEMBERED:]))
            self.words, self.ids = self.words.take(last), self.ids.take(last)
            self.used = self.used[last.to_numpy()]
        return ids

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; of a NULL, as of an empty one. Words are cut by numpy, counted, told apart
        and put together by Arrow; Python sees each new word once."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(
            pa.large_string()).fill_null("")
        if self.layout == "whole":
            return self._encode(texts.to_pylist())
        apart = pc.match_substring_regex(texts, self.apart, ignore_case=True)
        alone = (self._encode([t])[0] for t in texts.filter(apart).to_pylist())
        rest = iter(self._rest(texts.filter(pc.invert(apart))))
        return [next(alone if x else rest) for x in apart.to_pylist()]

    def _rest(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts without added tokens and doubtful characters."""
        if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
            return [b""] * len(texts)
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(data, np.uint8)[places[0]:places[-1]]
        places = places - places[0]
        starts = self._starts(raw, places)
        if self.one_case:
            raw = _small(raw)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))),
                                                 pa.py_buffer(raw)).dictionary_encode()
        ids = self._learn(words.dictionary).take(words.indices)
        _, ends, flat = ids.buffers()
        cuts = np.frombuffer(ends, np.int64, len(ids) + 1)[np.searchsorted(starts, places)].tolist()
        flat = flat.to_pybytes() if flat is not None else b""
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _starts(self, raw: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the words of UTF-8 texts begin that lie at `places`, always at token boundaries.

        White space goes with the word after it. Where it is not dropped, only one blank does; what
        is before it, or another last character, is a word of its own, and so is the end of a text.
        """
        size = len(raw)
        kinds = _KINDS[self.layout][raw]
        space = kinds == _SPACE
        wide = _wide_spaces(raw)
        for at, length in wide:
            for k in range(length):
                space[at + k] = True
        begins = np.zeros(size + 1, bool)
        begins[places] = True
        out = begins[:-1].copy()
        sign = np.flatnonzero(kinds == _SIGN)
        sign = sign[sign > 0]
        before = raw[sign - 1]
        cut = kinds[sign - 1] == _WORD
        high = np.flatnonzero(before >= 0x80)
        two = raw[np.maximum(sign[high] - 2, 0)]
        cut[high] = (two >= 0xc2) & (two <= 0xdf) & _IS_LETTER[
            (two & 0x1f).astype(np.int64) << 6 | before[high] & 0x3f]
        out[sign[cut]] = True
        change = space[1:] != space[:-1]
        change |= begins[1:-1]
        run = np.concatenate([[0], np.flatnonzero(change) + 1, [size]])
        run, end = run[:-1], run[1:]
        blank = space[run]
        run, end = run[blank], end[blank]
        out[run] = True
        if self.layout == "leading":
            inside = ~begins[end]
            run, end = run[inside], end[inside]
            last = end - 1
            for _ in wide and range(2):
                last -= (raw[last] & 0xc0) == 0x80
            out[last] = True
            out[end[raw[last] != 0x20]] = True
        return np.flatnonzero(out)


def _wide_spaces(raw: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Where white space beyond ASCII begins, and its length in bytes."""
    lead = np.flatnonzero((raw >= 0xc2) & (raw <= 0xe3))
    firsts, out = raw[lead], []
    for first, chars in itertools.groupby(_WIDE_SPACES, lambda c: c[0]):
        near = lead[firsts == first]
        for char in chars if len(near) else ():
            at = near
            for k, byte in enumerate(char[1:], 1):
                at = at[raw[at + k] == byte]
            if len(at):
                out.append((at, len(char)))
    return out


def _quoted(text: str) -> str:
    """The text as a pattern of Arrow's."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _small(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, but for those that a mark may follow."""
    large = (raw - 65).astype(np.uint8) < 26
    large[:-1] &= raw[1:] < 0x80
    return raw + (large.view(np.uint8) << 5)


def encoder(path: str) -> IdEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]
