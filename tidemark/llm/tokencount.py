"""Token counts of byte-level BPE by prefix dynamic programming.

For a byte-level BPE vocabulary the last token of the encoding of every prefix is unique: it is the one token that ends the
prefix and may stand after the last token of what remains. So ``count[i] = count[i - len(last)] + 1`` gives the exact count
at every prefix in one pass, and questions on truncation and budgets are answered from the stored counts without encoding
anything again. What each prefix of a pre-token (merges never cross their borders) adds is worked out once for each
pre-token and shared by all texts; a text's table is put together from these, and every answer is read off the table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_arrow, materialize

#: How the tokenizer's file must say that texts are split, with no normaliser before it.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Fixed value: the characters that the tokenizer's split pattern takes as white space, and that pattern.
_WS = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Wider than the above, which costs some texts the shorter way and nothing else.
_SPACES = re.compile(r"\s\s")
_SPACE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pre-tokens (of up to so many characters) and pairs of tokens that a worker keeps; as many again stay from before, so that
#: frequent ones are never lost.
CACHE, CACHE_CHARS = 500_000, 64
_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [spec.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")], spec["model"].get("type"), spec["model"].get("ignore_merges", False)
        if kinds != ([None, PRE_TOKENIZER, None], "BPE", False) or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: this tokenizer normalises or splits texts in another way")
        to = _byte_of_char()
        plain = lambda t: "".join([chr(to[c]) for c in t])
        self.ranks = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[plain(a), plain(b)] = k
        #: The two tokens that each token is merged from at last, and the rank of that merge; none for single bytes.
        self.halves = {t: pair for t in {a + b for a, b in self.ranks} if (pair := self._last_merge(t))}
        self.rank = {t: self.ranks[pair] for t, pair in self.halves.items()} | {chr(b): -1 for b in range(256)}
        self.tokens = set(self.rank)
        self.ends = ahocorasick.Automaton()
        for t in self.tokens:
            self.ends.add_word(t, (t, len(t)))
        self.ends.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.gains: dict[str, bytes] = {}
        self.old_gains: dict[str, bytes] = {}
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=lambda t: (-len(t), t))
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _merge(self, word: str, stop: int = 1) -> list[str]:
        """The encoding itself: the pair of lowest rank is merged first, until ``stop`` parts are left. Only asked for the
        vocabulary's tokens, once each."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > stop:
            best, at = min(((self.ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The halves of a token, if it is its own encoding."""
        pair = tuple(self._merge(token, 2))
        return pair if len(pair) == 2 and pair in self.ranks else None

    def _may_follow(self, a: str, b: str) -> bool:
        """Whether two tokens side by side are the encoding of their bytes.

        Their merges are undone from the last to the first, on the side of the border where the later one was. A pair that
        touches the border and has a lower rank than the merge undone there would have been merged before it.
        """
        key = (a, b)
        got = self.fits.get(key)
        if got is not None:
            return got
        if len(self.fits) >= 2 * CACHE:
            self.fits.clear()
        rank, ranks, halves = self.rank, self.ranks, self.halves
        before = 1 << 60  # merges below this rank come first
        got = True
        while True:
            if ranks.get((a, b), 1 << 60) < before:
                got = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, halves[a][1]
            else:  # of equal ranks the one to the left is merged first, so the pair at the border too
                before, b = rb + 1, halves[b][0]
        self.fits[key] = got
        return got

    def counts(self, word: str) -> list[int]:
        """Exact token count of every prefix of a pre-token, by bytes; entry 0 is the empty prefix. Bytes stand as characters
        of the same number. All tokens that end at a place come from one automaton, the longest first."""
        count, last, fits = [0] * (len(word) + 1), [""] * (len(word) + 1), self.fits
        done = 0
        for end, (token, size) in self.ends.iter(word):
            if end < done:
                continue
            before = end + 1 - size
            if before:
                pair = (last[before], token)
                fit = fits.get(pair)
                if not (self._may_follow(*pair) if fit is None else fit):
                    continue
            done = end + 1
            count[done], last[done] = count[before] + 1, token
        return count

    def _gains(self, word: str) -> bytes:
        """What each code point of a pre-token adds to the count, as signed bytes."""
        got = self.gains.get(word)
        if got is None:
            got = self.old_gains.get(word)
            if got is None:
                c = self.counts(word if word.isascii() else word.encode("utf-8").decode("latin-1"))
                if word in _CONTRACTIONS:  # a prefix of it is split otherwise
                    c = [0, 1, 2, c[-1]]
                elif not word.isascii():
                    c = [c[k] for k in accumulate((len(ch.encode("utf-8")) for ch in word), initial=0)]
                got = bytes([y - x & 255 for x, y in pairwise(c)])
            if len(word) <= CACHE_CHARS:
                if len(self.gains) >= CACHE:
                    self.old_gains, self.gains = self.gains, {}
                self.gains[word] = got
        return got

    def _total(self, word: str) -> int:
        return int(np.frombuffer(self._gains(word), np.int8).sum(dtype=np.int64))

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text) or not text:
            yield text[at:], False

    def table(self, text: str) -> bytes:
        """The prefix table of a text: what each code point adds to the count, as signed bytes.

        Three kinds of prefix split otherwise than the whole text: one that ends inside a run of white space, one inside a
        contraction (``_gains`` knows), one inside a special string. Texts without the first and last are put together from
        the gains of their pre-tokens as they are.
        """
        if not _SPACES.search(text) and not (self.special and self.special.search(text)):
            words = _SPLIT.findall(text)
            try:
                return b"".join(map(self.gains.__getitem__, words))
            except KeyError:
                return b"".join(map(self._gains, words))
        out: list[bytes] = []
        before, ahead = "", 0  # the piece before, and by how much the last prefix counts more than the pieces so far

        def put(at: list[int] | np.ndarray, n: int) -> None:
            nonlocal ahead
            out.append(np.diff(np.asarray(at), prepend=ahead).astype(np.int8).tobytes())
            ahead = int(at[-1]) - n

        for segment, special in self._segments(text):
            if special:
                lead = self._total(before) if before else 0
                put([*(sum(map(self._total, _SPLIT.findall(before + segment[:k]))) - lead for k in range(1, len(segment))), 1], 1)
                before = ""
                continue
            before = ""
            for word in _SPLIT.findall(segment):
                gains = self._gains(word)
                run = before and word[0] in _SPACE and before[-1] in _SPACE
                if run or ahead:
                    at = np.cumsum(np.frombuffer(gains, np.int8), dtype=np.int64)
                    n = int(at[-1])
                    if run:
                        at[0] = self._total(before + word[0]) - self._total(before)
                    put(at, n)
                else:
                    out.append(gains)
                before = word
        return b"".join(out)

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of every prefix of the text by code points, entry 0 for the empty one."""
        return [0, *np.cumsum(np.frombuffer(self.table(text), np.int8), dtype=np.int64).tolist()]


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One per worker and vocabulary, kept between tasks."""
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, prefixes``: the UTF-8 bytes and the prefix table of every whole text, compressed.

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor; one that normalises or splits texts in
    another way is refused. A null text is empty. Ids may be null or repeat; an empty table gives no rows; other columns are
    not looked at.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, prefixes binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        out = [zlib.compress(c.table(x or ""), 1) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "n_bytes", "prefixes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), run, schema)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars`` of every whole text: its UTF-8 bytes, exact token count, whether that
    is above ``limit``, and the code points of its longest prefix within ``limit``; all read off the stored prefix tables.
    Nulls and other cases as ``prefix_tables``.
    """
    return answer(materialize(prefix_tables(docs, tokenizer, id_col, text_col), "prefixes"), limit)


def answer(tables: DataFrame, limit: int) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars`` from stored prefix tables alone, for any ``limit``."""
    schema = f"id {tables.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fit = [], []
        for prefixes in batch.column(2).to_pylist():
            gains = np.frombuffer(zlib.decompress(prefixes), np.int8)
            n.append(int(gains.sum(dtype=np.int64)))
            fit.append(_longest(gains, limit))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return map_arrow(tables.select("id", "n_bytes", "prefixes"), run, schema)


def _longest(gains: np.ndarray, limit: int) -> int:
    within = np.flatnonzero(np.cumsum(gains, dtype=np.int64) <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def count_at(prefixes: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points, from a stored table."""
    return int(np.frombuffer(zlib.decompress(prefixes), np.int8)[:chars].sum(dtype=np.int64))


def longest_within(prefixes: bytes, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens, from a stored table."""
    return _longest(np.frombuffer(zlib.decompress(prefixes), np.int8), limit)
