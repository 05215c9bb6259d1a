"""Byte-level BPE over ragged numpy arrays: every sequence of a batch applies its own lowest-rank pair in each round."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed value: the public pre-token pattern of this kind of vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single blank between two visible characters: a pre-token always starts there.
BOUNDARY = regex.compile(r"(?<=\S) (?=\S)")
#: Blocks in which the Unicode versions of `regex` and of the tokenizer library agree on letters and numbers.
UNSETTLED = re.compile("[^\u0000-՗Ḁ-⁯₠-⯿　-鿿가-힣＀-￯\U0001f300-\U0001faff]")
NEVER = np.int32(2**31 - 1)
LONGEST_PART = 4_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class RankMerger:
    """The merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.byte_ids = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in content["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(self.keys.searchsorted(wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words that are done leave the working arrays."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        number = np.flatnonzero(lengths)
        symbols, lengths = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)], lengths[number]
        start = np.cumsum(lengths) - lengths
        rank = np.full(len(symbols), NEVER)
        if len(symbols) > 1:
            rank[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        rank[start + lengths - 1] = NEVER
        while len(number):
            lowest = np.minimum.reduceat(rank, start)
            live = lowest != NEVER
            if 2 * live.sum() <= len(live):
                for k in np.flatnonzero(~live):
                    out[number[k]] = symbols[start[k] : start[k] + lengths[k]]
                stay = np.repeat(live, lengths)
                symbols, rank = symbols[stay], rank[stay]
                number, lengths, lowest = number[live], lengths[live], lowest[live]
                start = np.cumsum(lengths) - lengths
                if not len(number):
                    break
            hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != NEVER))
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = np.diff(hit) != 1
            # of the overlapping hits in a run of one symbol, every second counts, from the left
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            lengths = np.add.reduceat(keep, start, dtype=np.int64)
            place = np.cumsum(keep) - 1
            hit = place[hit]
            symbols, rank = symbols[keep], rank[keep]
            start = np.cumsum(lengths) - lengths
            touched = np.zeros(len(symbols), dtype=bool)
            touched[hit] = touched[hit[hit > 0] - 1] = True
            changed = np.flatnonzero(touched[:-1])
            rank[changed] = self.pair_ranks(symbols[changed], symbols[changed + 1])
            rank[start + lengths - 1] = NEVER
        counts = np.array([len(x) for x in out], dtype=np.int64)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), counts


class SegmentEncoder:
    """Token counts or ids of whole texts. What lies between two single blanks is looked up in a bounded table; what is missing there is
    split into pre-tokens, and those not seen before are merged together. Counts add up as numbers, ids as bytes (unsigned 32 bits,
    little-endian)."""

    def __init__(self, path: str, ids: bool, remember: int = 1_000_000):
        self.merger, self.path, self.ids, self.remember = RankMerger(path), path, ids, remember
        self.segments: dict[str, int | bytes] = {}
        self.pretokens: dict[str, int | bytes] = {}
        self.library: Tokenizer | None = None
        self.total: Callable = b"".join if ids else sum
        special = "|".join(map(re.escape, self.merger.special))
        self.special = re.compile(f"({special})") if special else None

    def one(self, ids: Sequence[int]) -> int | bytes:
        return np.asarray(ids, dtype="<u4").tobytes() if self.ids else len(ids)

    def parts(self, text: str) -> Iterator[str | tuple[str, bool]]:
        """Special strings as they are; what lies between as (part, does a blank stand before it), cut where a pre-token starts."""
        for k, piece in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            if k % 2:
                yield piece
                continue
            first, blank = 0, False
            while len(piece) - first > LONGEST_PART and (cut := BOUNDARY.search(piece, first + LONGEST_PART)):
                yield piece[first : cut.start()], blank
                first, blank = cut.end(), True
            yield piece[first:], blank

    def encode(self, texts: Sequence[str | None]) -> list[int | bytes]:
        """A value for each text. The lists made on the way hold no cycles, so the collector would only walk them in vain."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> list[int | bytes]:
        known, plans, holes = self.segments.get, [], []
        after, heads = {}, {}  # segments with a blank before them, and those without
        for text in texts:
            plan = []
            for part in self.parts(text or ""):
                if isinstance(part, str):
                    plan.append(self.one([self.merger.special[part]]))
                    continue
                piece, blank = part
                if not piece:
                    continue
                found = list(map(known, segments := piece.split(" ")))
                if not blank:
                    found[0] = None
                    heads[segments[0]] = None
                if None in found:
                    empty = [k for k, v in enumerate(found) if v is None]
                    unknown = [segments[k] for k in empty]
                    if "" in unknown or list(map(str.strip, unknown)) != unknown:
                        unknown = BOUNDARY.split(piece)
                        found, empty = [None] * len(unknown), range(len(unknown))
                    if not blank:
                        heads[unknown[0]] = None
                    after.update(dict.fromkeys(unknown if blank else unknown[1:]))
                    holes.append((found, empty, unknown, blank))
                plan.append(found)
            plans.append(plan)
        self.fill(after, " ")
        self.fill(heads, "")
        for found, empty, unknown, blank in holes:
            for k, segment in zip(empty, unknown):
                found[k] = after[segment] if k or blank else heads[segment]
        return [self.total([self.total(x) if isinstance(x, list) else x for x in plan]) for plan in plans]

    def fill(self, missing: dict[str, int | bytes | None], blank: str) -> None:
        """Values of segments that follow `blank`. A word of letters alone is one pre-token."""
        split, foreign = {}, [s for s in missing if not s.isascii() and UNSETTLED.search(s)]
        words = [s for s in missing if s.isalpha()]
        for s in missing:
            if not s.isalpha():
                split[s] = PRETOKEN.findall(blank + s)
        unseen = list({p for found in split.values() for p in found}.difference(self.pretokens))
        local, encoded = dict(zip(unseen, self.values(unseen, ""))), self.values(words, blank)
        missing.update(zip(words, encoded))
        for s, found in split.items():
            missing[s] = self.total([self.pretokens[p] if p in self.pretokens else local[p] for p in found])
        for s in foreign:
            self.library = self.library or Tokenizer.from_file(self.path)
            missing[s] = self.one(self.library.encode(blank + s, add_special_tokens=False).ids)
        if len(self.pretokens) < self.remember // 4:
            self.pretokens.update((p, v) for p, v in local.items() if len(p) < 64)
        if blank and len(self.segments) < self.remember:
            self.segments.update((s, v) for s, v in missing.items() if 0 < len(s) < 64 and s.strip() == s)

    def values(self, pretokens: list[str], blank: str) -> list[int | bytes]:
        flat, counts = self.merger.merge([(blank + p).encode() for p in pretokens])
        if not self.ids:
            return counts.tolist()
        whole, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


class TextEncoder:
    """Token ids of whole texts as bytes (unsigned 32 bits, little-endian), by a compiled byte-pair encoder over the same vocabulary.

    The encoder takes ids for ranks, which holds for files whose ids follow their merges; others are refused. Texts that it might split
    differently (letters of which the libraries know different versions, very long blanks) go through SegmentEncoder.
    """

    BLANKS = regex.compile(r"\s{5000}")

    def __init__(self, path: str):
        import tiktoken

        self.path, self.careful = path, None
        merger = RankMerger(path)
        if (np.diff(merger.merged) <= 0).any() or merger.byte_ids.max() >= merger.merged[0]:
            raise ValueError(f"the ids of {path} don't follow its merges")
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in vocabulary.items() if token not in merger.special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens=merger.special)
        self.specials = set(merger.special)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif not text.isascii() and UNSETTLED.search(text) or len(text) > 10_000 and self.BLANKS.search(text):
                self.careful = self.careful or SegmentEncoder(self.path, ids=True)
                out.append(self.careful.encode([text])[0])
            else:
                special = "<" in text and any(s in text for s in self.specials)
                ids = self.encoding.encode(text, allowed_special="all") if special else self.encoding.encode_ordinary(text)
                out.append(np.array(ids, dtype="<u4").tobytes())
        return out
