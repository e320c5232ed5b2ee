"""Byte-level BPE encoding and decoding by a walk over the trie of distinct words."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NEVER = 1 << 60
#: Words that each of a task's two generations remembers, and the longest that it remembers.
CACHE_WORDS = 100_000
CACHED_BYTES = 256
#: Every so many bytes of a long word its state is computed before those behind.
STEP_BYTES = 128
#: Last bytes of a prefix that tell which lengths its last token can have.
TAIL = 4
#: Token pairs whose boundary a worker remembers.
CACHE_PAIRS = 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def plain_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts without code points above U+FFFF, as the standard library's faster ``re`` reads it; None for patterns that need more.

    Letters, numbers and white space become ranges, which come from ``regex`` itself.
    """
    every = "".join(map(chr, range(0x10000)))
    ranges = {name: "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{name}+", every)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|\(\?.|.", pattern, re.DOTALL):
        if part in ranges:
            out.append(ranges[part] if inside else f"[{ranges[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{ranges[chr(92) + 's']}]")
        elif part[0] == "\\" or part in "{}" or (part == "[" and inside) or (part[:2] == "(?" and part not in ("(?!", "(?=", "(?:")):
            return None
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return None if re.search(r"[*+?]\+|[-&|~]{2}", pattern) else re.compile("".join(out))


class TrieEncoder:
    """A byte-level BPE vocabulary that encodes many distinct words at once.

    The encoding of a word's prefix is fixed by its last token alone: what precedes is the encoding of the shorter prefix. So each trie node
    (a prefix) needs just its last token, found from the nodes above it: the one vocabulary entry that ends there, is whole when encoded
    alone, and keeps its boundary with the last token of the prefix before it. Words in sorted order are a depth-first walk of the trie;
    the states on the path that a word shares with the one before it are kept, and only those that some word's encoding rests on are computed.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # Lists by id, as a worker keeps its encoder for as long as it lives.
        n = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * n
        self.rank, self.parts = [-1] * n, ([-1] * n, [-1] * n)
        for token, i in vocab.items():
            self.bytes_of[i] = as_bytes(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.made = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.made[vocab[a], vocab[b]] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[0][whole], self.parts[1][whole] = r, vocab[a], vocab[b]
        self.size_of = list(map(len, self.bytes_of))
        self._fits: dict[tuple[int, int], bool] = {}
        whole = [False] * n  # encoded alone, is it one token?
        for token in sorted(vocab.values(), key=self.rank.__getitem__):
            a, b = self.parts[0][token], self.parts[1][token]
            whole[token] = a < 0 or (whole[a] and whole[b] and self.apart(a, b, self.rank[token]))
        self.ends = {self.bytes_of[t]: t for t in vocab.values() if whole[t]}
        # The lengths of the entries that end in the same bytes, longest first: only those can end where a prefix with these last bytes does.
        tails, short = {}, {}
        for w in self.ends:
            if len(w) < TAIL:
                short.setdefault(len(w), set()).add(w)
            else:
                tails.setdefault(w[-TAIL:], set()).add(len(w))
        self.lengths = {t: (*sorted(n, reverse=True), *(k for k in sorted(short, reverse=True) if t[-k:] in short[k])) for t, n in tails.items()}
        self.short = tuple(sorted(short, reverse=True))
        self.pattern, self.plain = regex.compile(pattern), plain_pattern(pattern)
        self.far = re.compile("[^\0-\uffff]")
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether merging ``left`` and ``right`` each on its own, up to rank ``until``, never meets a merge across their boundary.

        Goes back in time: the pair at the boundary exists until the next merge of either side, and a merge of the pair with a lower rank
        than that one (or the same rank, if the next merge is on the right, as the left one of two equal pairs merges first) comes before.
        """
        while True:
            across = self.made.get((left, right))
            if across is not None and across < until:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, until = self.parts[1][left], a
            else:
                right, until = self.parts[0][right], b + 1

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > CACHE_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self.apart(left, right)
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of each distinct word, in byte order."""
        find, fits, known, lengths, short, size_of = self.ends.get, self.fits, self._fits, self.lengths.get, self.short, self.size_of
        before, last = b"", []  # last: the last token of each prefix of the word, -1 where no word has asked for it

        def state(word: bytes, end: int) -> int:
            token = last[end - 1]
            if token < 0:
                for size in lengths(word[end - TAIL : end], short) if end >= TAIL else short:
                    start = end - size
                    if start < 0:
                        continue
                    token = find(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        left = last[start - 1]
                        if left < 0:
                            left = state(word, start)
                        fit = known.get((left, token))
                        if fit or (fit is None and fits(left, token)):
                            break
                last[end - 1] = token
            return token

        for word in sorted(words):
            n, shared = len(word), 0
            top = min(n, len(before))
            if word[:top] == before[:top]:
                shared = top
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared:]
            last += [-1] * (n - shared)
            for end in range(STEP_BYTES, n, STEP_BYTES):
                state(word, end)  # from the front, so that the states of a very long word do not wait for each other in a deep chain
            ids, end = [], n
            while end:
                token = last[end - 1]
                if token < 0:
                    token = state(word, end)
                ids.append(token)
                end -= size_of[token]
            yield word, ids[::-1]
            before = word

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; a special token's string is a piece of its own."""
        findall = (self.pattern if self.plain is None or self.far.search(text) else self.plain).findall
        if self.marks is None or not any(m in text for m in self.special):
            return findall(text)
        found: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            found += [part] if k % 2 else findall(part)
        return found


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TrieEncoder:
    """One encoder per Python worker."""
    return TrieEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False, decode: bool = True) -> DataFrame:
    """Encode and decode whole texts: rows (doc_id, ids array<int>, decoded), or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ``path`` is a vocabulary file and must exist on every executor. The string of a special token becomes its id. The distinct words of a
    batch that the task has not met before are encoded in one walk of their trie; a task remembers a bounded number of words.
    decoded joins the bytes of the ids, bytes that are no UTF-8 replaced: each distinct word is decoded from its ids, and only those that do not
    come out as they were are remembered. Without ``decode`` there is no such column, unless digests are asked
    for. A null text counts as empty: no ids, an empty decoded text. Repeated rows are encoded each; other columns are dropped; an empty table
    gives an empty one. No row is shuffled.
    """
    decode = decode or digests
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>" + ", decoded string" * decode

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        # The ids of each known word, and the decoded text of those that do not decode to themselves. Flat values: nothing for the garbage collector to follow.
        ids, texts, old_ids, old_texts = {}, {}, {}, {}
        kept = (lambda got: ",".join(map(str, got))) if digests else (lambda got: array("i", got).tobytes())

        def know(word: str, got: list[int]) -> None:
            ids[word] = kept(got)
            if decode:
                # A word is whole characters, so it is decoded as it is within its text.
                plain = b"".join([bpe.bytes_of[i] for i in got]).decode("utf-8", "replace")
                if plain != word:
                    texts[word] = plain

        def decoded(pieces: list[str]) -> str:
            return "".join(pieces if not texts or texts.keys().isdisjoint(pieces) else [texts.get(w, w) for w in pieces])

        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                cut = [bpe.pieces(t or "") for t in part["text"]]
                fresh = []
                for w in set().union(*cut).difference(ids):
                    if w in old_ids:
                        ids[w] = old_ids[w]
                        if w in old_texts:
                            texts[w] = old_texts[w]
                    elif w in bpe.special:
                        know(w, [bpe.special[w]])
                    else:
                        fresh.append(w)
                fresh.sort()  # code points and their bytes have the same order
                for w, (_, got) in zip(fresh, bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True):
                    know(w, got)
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy()})
                if digests:
                    joined = [",".join(map(ids.__getitem__, pieces)) for pieces in cut]
                    out["n_tokens"] = [j.count(",") + 1 if j else 0 for j in joined]
                    out["ids_sha256"] = [hashlib.sha256(j.encode()).hexdigest() for j in joined]
                    out["decoded_sha256"] = [hashlib.sha256(decoded(pieces).encode()).hexdigest() for pieces in cut]
                else:
                    out["ids"] = pd.Series([np.frombuffer(b"".join(map(ids.__getitem__, pieces)), np.intc) for pieces in cut], dtype=object)
                    if decode:
                        out["decoded"] = [decoded(pieces) for pieces in cut]
                yield out
                for w in fresh:
                    if len(w) > CACHED_BYTES:
                        del ids[w]
                        texts.pop(w, None)
                if len(ids) > CACHE_WORDS:
                    ids, texts, old_ids, old_texts = {}, {}, ids, texts

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, schema)
