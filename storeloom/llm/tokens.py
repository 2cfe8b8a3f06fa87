"""Token ids of whole texts, equal to the tokenizers library's, at a few times its speed.

The tokenizer's own file is the only source. Words of Latin letters, digits and
common punctuation go through a rank table made from that file's vocabulary
and merges (byte-pair merging by tiktoken, one call a text). Only the words with another
character, or with the string of a special token, go through the tokenizers
library itself, each distinct one of a block once: a text is parted where no match
of the tokenizer's pattern can run on, which is at white space. tests/llm holds both paths against each other.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def default_path(name: str) -> str:
    """Where the vocabulary files are; a parameter of every operator that tokenizes."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters on which the libraries' Unicode tables and normalisations can't differ.
_NOT_PLAIN = "[^\t\n\r -~¡-įı-ɏ]"
_PLAIN = re.compile(_NOT_PLAIN)
#: White space that parts a text for the word tokenizer, and a space that begins a word for the byte tokenizer:
#: what stands on both sides of it is white space in no version of Unicode.
_SPACE = re.compile("[ \t\n\r]+")
_SOLID = "[^\x00- \x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
_BEGIN = re.compile(f"(?<={_SOLID}) (?={_SOLID})")
#: Stands before a chunk that isn't normalised nor parted into words yet; not in _PLAIN either.
CHUNK = "\x01"
#: Closes a word in the rank table; not in _PLAIN, so never part of a text there.
_END = "\x00"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _over_plain(pattern: str) -> re.Pattern | None:
    """A pattern of letters and numbers for Python's own engine, with these classes written out for the plain characters; None if it has others."""
    import regex

    for kind in (r"\p{L}", r"\p{N}"):
        members = [c for c in range(0x250) if not _PLAIN.search(chr(c)) and regex.match(kind, chr(c))]
        ranges = [(a, b) for a, b in zip([c for c in members if c - 1 not in members], [c for c in members if c + 1 not in members])]
        pattern = pattern.replace(kind, "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges))
    return None if r"\p" in pattern or r"\P" in pattern else re.compile(pattern)


class FastTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab_size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bits = max(1, (self.vocab_size - 1).bit_length())
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.by_word = bool(suffix)
        letters = _byte_letters()

        def raw(piece: str) -> bytes:
            ended = self.by_word and piece.endswith(suffix)
            body = piece[: -len(suffix)] if ended else piece
            return bytes(letters[c] for c in body) + (_END.encode() if ended else b"")

        ranks = {raw(piece): i for piece, i in model["vocab"].items()}
        ordered = [ranks[raw(a) + raw(b)] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        steps = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        #: Ranks stand for merges only if ids ascend with the merges.
        self.fast = ordered == sorted(ordered) and len(ranks) == len(model["vocab"])
        self._words = None
        if self.by_word:
            split = next((s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]), None)
            self.fast = self.fast and split is not None and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            if self.fast:
                self.pattern = split["pattern"]["Regex"]
                self._words = (_over_plain(self.pattern) or regex.compile(self.pattern)).findall
            rule = f"[^{_END}]*{_END}"
        else:
            import public_tokenizers

            self.fast = self.fast and spec["normalizer"] is None and bool(steps) and steps[0].get("use_regex") and not steps[0]["add_prefix_space"]
            rule = public_tokenizers.PATTERN
        #: Whether an id ends a word.
        self._closes = np.zeros(self.vocab_size, bool)
        if self.by_word:
            self._closes[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        self._ranked = tiktoken.Encoding("ranked", pat_str=rule, mergeable_ranks=ranks, special_tokens={}) if self.fast else None
        self._odd = re.compile("|".join([_NOT_PLAIN, *map(re.escape, self.special)]))
        # a special token that takes white space about it, or holds some, leaves no place to part a text at
        self.parts = self.fast and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or _SPACE.search(t["content"]) for t in spec["added_tokens"])

    def plain(self, text: str) -> bool:
        """Whether the rank table gives the ids of this text."""
        return self.fast and not _PLAIN.search(text) and not any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint32."""
        return self.encode_many([text])[0]

    def words(self, text: str) -> list[str]:
        """The words of a plain text; of another, its chunks between white space, each marked by CHUNK."""
        if self.plain(text):
            return self._words(text.lower())
        if not self.parts:
            return [CHUNK + text]
        return [CHUNK + x for x in _SPACE.split(text) if x]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """A text for the byte tokenizer as runs of plain words, and as single words that aren't plain (True)."""
        odd = [m.start() for m in self._odd.finditer(text)]
        if not odd and self.fast:
            return [(text, False)]
        if not self.parts:
            return [(text, True)]
        cuts = np.array([0, *(m.start() for m in _BEGIN.finditer(text)), len(text)])
        out, done = [], 0
        for k in np.unique(np.searchsorted(cuts, odd, "right") - 1).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            if done < a:
                out.append((text[done:a], False))
            out.append((text[a:b], True))
            done = b
        return out + ([(text[done:], False)] if done < len(text) else [])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after the other, and the offsets of each; a distinct word is encoded once."""
        if self.by_word:
            words: list[str] = []
            ends = [0]
            for t in texts:
                words += self.words(t) if self.fast else [CHUNK + t]
                ends.append(len(words))
            return self.by_position(pa.array(words, pa.string()), np.diff(ends))
        found = [self.segments(t) for t in texts]
        table = list({x: None for parts in found for x, odd in parts if odd})
        slow = dict(zip(table, self.slow(table)))
        parts = [slow[x] if odd else self._ranked.encode_to_numpy(x) for parts in found for x, odd in parts]
        ends = np.cumsum([0, *map(len, parts)])
        return np.concatenate([np.empty(0, np.uint32), *parts]), ends[np.cumsum([0, *map(len, found)])]

    def by_position(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the ids of a table of distinct words and chunks back to where they stand; counts: words of each text."""
        coded = pc.dictionary_encode(words)
        ids, starts, lengths = self._table(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        before = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        flat = ids[np.repeat(starts[codes] - before[:-1], each) + np.arange(before[-1])]
        return flat, before[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def _table(self, table: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words and chunks, and where each one's begin and how many they are."""
        marked = [i for i, w in enumerate(table) if w[:1] == CHUNK]
        # a chunk that is plain becomes its words, any other one goes to the library
        parted = {i: self._words(table[i][1:].lower()) if self.plain(table[i][1:]) else None for i in marked}
        flat = [w for i, x in enumerate(table) for w in (parted[i] or () if i in parted else (x,))] if marked else table
        ids = self._ranked.encode_to_numpy(_END.join(flat) + _END) if flat else np.empty(0, np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self._closes[ids]) + 1]).astype(np.int64) if flat else np.zeros(1, np.int64)
        if not marked:
            return ids.astype(np.uint32), ends[:-1], np.diff(ends)
        sizes = np.ones(len(table), np.int64)
        sizes[marked] = [len(parted[i] or ()) for i in marked]
        at = np.concatenate([[0], np.cumsum(sizes)])
        starts, lengths = ends[at[:-1]], ends[at[1:]] - ends[at[:-1]]
        odd = [i for i in marked if parted[i] is None]
        if odd:
            slow = self.slow([table[i][1:] for i in odd])
            sizes = np.array([len(x) for x in slow], np.int64)
            starts[odd], lengths[odd] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, *slow])
        return ids.astype(np.uint32), starts, lengths

    def slow(self, texts: list[str]) -> list[np.ndarray]:
        """The library's own ids."""
        return [np.array(x.ids, dtype=np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)] if texts else []

    def pieces(self) -> list[str]:
        """The piece of each id."""
        return [self.library.id_to_token(i) or "" for i in range(self.vocab_size)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> FastTokenizer:
    """One tokenizer a worker process and file."""
    return FastTokenizer(path)
