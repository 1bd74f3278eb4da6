"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word one last token is right: the one that ends the prefix and is compatible with the last token
of what stands before it. Candidates come from a generalised suffix automaton of the vocabulary (its state at a prefix
is the longest suffix that occurs in a token; suffix links lead to all shorter ones); two tokens are compatible if the
merges of their joined text never cross the seam. Back-pointers from the end give the ids; no merge loop runs over a word.
The words that are new in a batch of texts go through it together, position by position.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table, trimmed

#: Fixed values of the vocabulary file's format: how it splits words between white space, and its word end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters whose classes and forms no version of Unicode changes; texts between white space with others are normalised and split (not encoded) by the library.
PLAIN = r"\x21-\x7e\xa1-ʯΑ-ΡΤ-ρσ-ωА-я‐-‧‰-›€"
#: White space by Unicode.
BLANK = "\t-\r \x85\xa0  -     　"
#: A character that is not plain, and what stands around it between white space.
ODD = re.compile(f"[^{PLAIN}{BLANK}]")
STRANGE = re.compile(f"((?<![^{BLANK}])[{PLAIN}]*+[^{PLAIN}{BLANK}][^{BLANK}]*+)")
#: Words that a worker remembers before it starts afresh, if not told otherwise.
REMEMBERED = 300_000
#: Positions that fewer words than this reach are no work for arrays: the longer words go one by one.
TOGETHER = 64
#: Texts that are encoded together.
TEXTS = 250
#: Bits of a token id (a pair is one number), of a byte, and of a place in the table of pairs.
ID_BITS, CHAR_BITS, PAIR_BITS = 20, 8, 19

assert sys.byteorder == "little" and array("I").itemsize == 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def plain_split() -> re.Pattern:
    """SPLIT for plain text in lower case: its letters and digits by name, which ``re`` finds in half the time."""
    chars = {d for c in re.findall(f"[{PLAIN}]", "".join(map(chr, range(0x3000)))) for d in unicodedata.normalize("NFC", c).lower()}
    letters, digits = ("".join(sorted(c for c in chars if regex.fullmatch(kind, c))) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(SPLIT.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", BLANK))


class Words(dict):
    """Ids and token names of words. A word that isn't there gets a cell, which is filled with those of all ``new`` words."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> list:
        self.new.append(word)
        cell = self[word] = [b"", ""]
        return cell


class Vocabulary:
    """``spec``: the text of a vocabulary file (BPE, NFC and lower case, byte characters, word ends, no decoder)."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.library = Tokenizer.from_str(spec)
        spec = json.loads(spec)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        #: of each id
        self.names = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = t
        self.chars = byte_chars()
        #: bytes of each token, and the merge that makes it
        self.size, self.rank = [0] * len(self.names), [-1] * len(self.names)
        for t, i in self.ids.items():
            self.size[i] = len(t.removesuffix(WORD_END)) or len(t)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            pair, to = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merged[pair] = r
            if to not in self.parts:
                self.parts[to], self.rank[to] = pair, r
        self.fits: dict[int, bool] = {}
        self.known = Words()
        self.odd: dict[str, list[str]] = {}
        self._automaton()
        self._arrays()
        self.split = plain_split()
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: What all special tokens begin with: texts without it have none.
        self.marker = os.path.commonprefix([*self.special])

    def _automaton(self) -> None:
        """Suffix automaton of all token bodies. ``tokens``: the token that is the longest string of each state, within a word and (as many places further) at its end; ``above``: the next state by suffix links that has such a token."""
        link, length, step = [-1], [0], [{}]

        def extend(last: int, c: str) -> int:
            if (q := step[last].get(c)) is not None and length[q] == length[last] + 1:
                return q
            fresh = q is None
            if fresh:
                cur = len(link)
                link.append(0), length.append(length[last] + 1), step.append({})
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                if p < 0:
                    return cur
                q = step[p][c]
            else:
                p, cur = last, -1
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
            copy = len(link)
            link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q]))
            link[q] = copy
            if fresh:
                link[cur] = copy
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
            return cur if fresh else copy

        bodies = {t.removesuffix(WORD_END) for t in self.ids}
        for body in bodies:
            s = 0
            for c in body:
                s = extend(s, c)
        inner, final = [-1] * len(link), [-1] * len(link)
        for t, i in self.ids.items():
            body, s = t.removesuffix(WORD_END), 0
            for c in body:
                s = step[s][c]
            # length[s] == len(body): a whole body never lies inside a longer class, as it starts at the root
            if length[s] == len(body):
                (final if t.endswith(WORD_END) and t != WORD_END else inner)[s] = i
        tokens, n = inner + final, len(link)
        above = [0] * len(tokens)
        for s in sorted(range(1, n), key=length.__getitem__):
            k = link[s]
            above[s] = k if tokens[k] >= 0 else above[k]
            above[n + s] = k if tokens[n + k] >= 0 else above[n + k]
        self.link, self.length, self.tokens, self.above = link, length, tokens, above
        byte = {c: b for b, c in enumerate(self.chars)}
        # a dict for each state would take twice the memory
        self.step = {s << CHAR_BITS | byte[c]: k for s, to in enumerate(step) for c, k in to.items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined text of tokens a and b give just (a, b).

        The seam's neighbours are taken apart from the latest merge backwards; a merge across it that comes before the
        one taken apart would have been made first. At equal ranks the left one is made first.
        """
        x, y, before = a, b, (1 << 60, 0)
        while True:
            r = self.merged.get((x, y))
            if r is not None and (r, 1) < before:
                out = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                out = True
                break
            if rx > ry:  # made after y: what still can cross comes before it
                x, before = self.parts[x][1], (rx, 0)
            else:
                y, before = self.parts[y][0], (ry, 2)
        self.fits[a << 20 | b] = out
        return out

    def symbols(self, word: bytes) -> list[int]:
        """The ids of one split word."""
        n, step, link, lengths, fits, end = len(word), self.step, self.link, self.length, self.fits, len(self.link)
        state, length, last = 0, 0, [-1]
        for i in range(1, n + 1):
            c = word[i - 1]
            while (to := step.get(state << CHAR_BITS | c)) is None and state:
                state = link[state]
                length = lengths[state]
            if to is not None:
                state, length = to, length + 1
            kind = end if i == n else 0
            at, found = state, -1
            while at:
                if (t := self.tokens[at + kind]) >= 0 and lengths[at] <= length:
                    j = i - lengths[at]
                    if j == 0:
                        fit = self.whole[t]
                    elif (prev := last[j]) < 0:
                        fit = False
                    elif (fit := fits.get(prev << 20 | t)) is None:
                        fit = self.compatible(prev, t)
                    if fit:
                        found = t
                        break
                at = self.above[at + kind]
            last.append(found)
        out, i = [], n
        while i:
            out.append(last[i])
            i -= self.size[last[i]]
        return out[::-1]

    def _arrays(self) -> None:
        """The automaton, the merges and the halves of tokens as arrays; ``whole[t]``: whether the text of token t is encoded as t alone."""
        goto, to = (np.fromiter(x, np.int64, len(self.step)) for x in (self.step.keys(), self.step.values()))
        order = np.argsort(goto)
        self.goto, self.to = np.append(goto[order], 1 << 40), np.append(to[order], 0)
        self.links, self.lengths, self.ends, self.aboves = map(np.array, (self.link, self.length, self.tokens, self.above))
        self.sizes, self.ranks = np.array(self.size), np.array(self.rank)
        self.left, self.right = np.full((2, len(self.names)), -1)
        made = sorted(self.parts, key=self.rank.__getitem__)
        self.left[made], self.right[made] = np.fromiter((x for t in made for x in self.parts[t]), np.int64).reshape(-1, 2).T
        pairs = np.fromiter((x for (a, b), r in self.merged.items() for x in (a << ID_BITS | b, r)), np.int64).reshape(-1, 2)
        self.pairs, self.pair_ranks = np.append(pairs[np.argsort(pairs[:, 0])].T, [[1 << 60], [1 << 40]], 1)
        #: Pairs of tokens and in the last bit whether they are compatible; a later pair takes an earlier one's place.
        self.seen = np.full(1 << PAIR_BITS, -1)
        whole = [True] * len(self.names)
        # the merge that makes t is made, if its halves are left alone until then
        for t, alone in zip(made, self._seam(self.left[made], self.right[made], 4 * self.ranks[made] + 1).tolist()):
            a, b = self.parts[t]
            whole[t] = alone and self.merged[a, b] == self.rank[t] and whole[a] and whole[b]
        self.whole, self.wholes = whole, np.array(whole)

    def _seam(self, x: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """As ``compatible``, of many pairs; ``before``: four times the rank, and how ties at it are broken."""
        out, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            pair = x << ID_BITS | y
            k = np.searchsorted(self.pairs, pair)
            crossed = (self.pairs[k] == pair) & (4 * self.pair_ranks[k] + 1 < before)
            out[at[crossed]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, before = at[go], x[go], y[go], rx[go], ry[go], before[go]
            first = rx > ry
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            before = np.minimum(before, np.where(first, 4 * rx, 4 * ry + 2))
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens a are compatible with those of b."""
        pair = a << ID_BITS | b
        place = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        got = self.seen[place(pair)]
        out = got & 1 == 1
        if len(other := np.flatnonzero(got >> 1 != pair)):
            k, back = np.unique(pair[other], return_inverse=True)
            fit = self._seam(k >> ID_BITS, k & (1 << ID_BITS) - 1, np.full(len(k), 1 << 60))
            self.seen[place(k)] = k << 1 | fit
            out[other] = fit[back]
        return out

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of split words, longest first, one after the other, and where each word's begin (and the last one's end)."""
        n = np.array([*map(len, words)])
        codes, start = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(n) - n
        # words of i bytes at least; the last tokens of prefixes of i bytes begin at off[i], in the words' order
        reach = np.searchsorted(-n, -np.arange(n[0] + 2), "right")
        off = np.cumsum(reach) - reach
        last = np.full(off[-1], -1)
        states, end = np.zeros(len(n), np.int64), len(self.link)
        lengths = states.copy()
        for i in range(1, n[0] + 1):
            m = reach[i]
            state, length, c = states[:m], lengths[:m], codes[start[:m] + i - 1]
            at, key = np.arange(m), state << CHAR_BITS | c
            while True:
                k = np.searchsorted(self.goto, key)
                there = self.goto[k] == key
                state[at[there]] = self.to[k[there]]
                length[at[there]] += 1
                at = at[~there]
                at = at[state[at] > 0]
                if not len(at):
                    break
                state[at] = self.links[state[at]]
                length[at] = self.lengths[state[at]]
                key = state[at] << CHAR_BITS | c[at]
            w, here, kind = np.arange(m), state.copy(), np.where(np.arange(m) < reach[i + 1], 0, end)
            while True:
                go = here > 0
                w, here = w[go], here[go]
                if not len(w):
                    break
                t, size = self.ends[here + kind[w]], self.lengths[here]
                k = np.flatnonzero((t >= 0) & (size <= length[w]))
                tk, j = t[k], i - size[k]
                prev = last[off[j] + w[k]]
                fit = self.wholes[tk] & (j == 0)
                k2 = np.flatnonzero(prev >= 0)
                fit[k2] = self._fit(prev[k2], tk[k2])
                last[off[i] + w[k[fit]]] = tk[fit]
                left = np.ones(len(w), bool)
                left[k[fit]] = False
                w, here = w[left], here[left]
                here = self.aboves[here + kind[w]]
        found, w, at = [], np.arange(len(n)), n.copy()
        count = np.zeros(len(n), np.int64)
        while len(w):
            t = last[off[at] + w]
            found.append((w, t))
            count[w] += 1
            at = at - self.sizes[t]
            w, at = w[at > 0], at[at > 0]
        start = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(start[-1], "<u4")
        for k, (w, t) in enumerate(found):
            ids[start[w + 1] - 1 - k] = t
        return ids, start

    def words(self, text: str) -> list[str]:
        """The split words of a text without special tokens."""
        parts = STRANGE.split(text) if ODD.search(text) else (text,)
        # the same in every version of Unicode; lower case character by character
        out = self.split.findall(unicodedata.normalize("NFC", parts[0]).lower())
        for odd, plain in zip(parts[1::2], parts[2::2]):
            out += self.odd.get(odd) or self.odd_words(odd)
            out += self.split.findall(unicodedata.normalize("NFC", plain).lower())
        return out

    def odd_words(self, chunk: str) -> list[str]:
        byte = {c: b for b, c in enumerate(self.chars)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        out = self.odd[chunk] = [bytes(map(byte.__getitem__, w)).decode() for w, _ in found]
        return out

    def learn(self) -> None:
        """Fills the cells of all new words."""
        new = sorted(((s.encode(), self.known[s]) for s in self.known.new), key=lambda x: len(x[0]), reverse=True)
        one = len(new)
        if one >= TOGETHER:
            size = len(new[TOGETHER - 1][0])
            one = next(k for k, (s, _) in enumerate(new) if len(s) == size)
        for s, cell in new[:one]:
            ids = self.symbols(s)
            cell[:] = array("I", ids).tobytes(), " ".join(map(self.names.__getitem__, ids))
        if new := new[one:]:
            ids, start = self.together([s for s, _ in new])
            names, ids, start = [*map(self.names.__getitem__, ids.tolist())], ids.tobytes(), start.tolist()
            for (_, cell), a, b in zip(new, start, start[1:]):
                cell[0] = ids[4 * a : 4 * b]
                cell[1] = " ".join(names[a:b]) if b - a > 1 else names[a]
        self.known.new.clear()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each whole text the little-endian 32-bit ids, and their decoded text (token names joined by blanks)."""
        found = []
        for text in texts:
            cells = []
            for piece in self.cut.split(text) if self.special and self.marker in text else (text,):
                if piece in self.special:
                    cells.append((self.special[piece].to_bytes(4, "little"), piece))
                else:
                    cells += map(self.known.__getitem__, self.words(piece))
            found.append(cells)
        self.learn()
        out = [(b"".join([x for x, _ in cells]), " ".join([x for _, x in cells])) for cells in found]
        for held, most in ((self.known, self.remembered), (self.fits, self.remembered), (self.odd, self.remembered // 3)):
            if len(held) > most:
                held.clear()
        return out


_loaded: dict[int, Vocabulary] = {}


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, keep: bool = True, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ids binary (little-endian 32-bit), decoded string`` for every row of ``docs``, and the columns ``others`` as they are.

    A null text is an empty one: no ids, empty decoded text. ``path``: the vocabulary file, on the driver; its text (a
    few MB, fixed) is broadcast. Repeated rows and null ids are kept as they are; texts of any length are encoded whole; an
    empty table gives no rows; other columns play no part. No ties: each prefix of a word has one last token. ``remembered`` bounds a worker's memory
    at about 1 KB each, at some cost in speed; ``keep``: whether it holds its tables between tasks.
    """
    spec = open(path or default_path(), encoding="utf-8").read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    key = hash((spec, remembered))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Vocabulary(sent.value, remembered)
        v = _loaded[key]
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                out = v.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string()), *part.columns[2:]], ["doc_id", "ids", "decoded", *others])
        if not keep:
            _loaded.clear()

    schema = "doc_id long, ids binary, decoded string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others).mapInArrow(trimmed(encoded), schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded."""
    rows = encode_decode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
