"""BPE on our own: priority-queue merging (operator 10), prefix dynamic programming (operator 3).

The tokenizers library reads the vocabulary file and does normalising and pre-tokenising; merging, counting and
decoding are done here.  Both parts work on chunks, the pieces between which no token can reach, and memoise them.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np

from .common import Generations

#: Unicode White_Space, as the libraries' \s; Python's own \s also takes U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A space that follows other white space: cutting in front of it could split a run.
MIXED = re.compile(rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) ")
#: Letters that stay together, then a run of ASCII marks, which is a pre-token of its own.  No apostrophe (contractions),
#: no '<' (special tokens).
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")


@functools.lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Starters that may compose with what stands in front of them (by Unicode's data; Hangul vowels and finals by rule)."""
    second = {d[1] for c in range(0x30000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<"}
    return frozenset(chr(int(x, 16)) for x in second) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def as_bytes(counts: list[int]) -> bytes:
    """Steps between counts as signed bytes."""
    steps = [y - x for x, y in zip(counts, counts[1:])]  # noqa: B905
    if steps and not -129 < min(steps) <= max(steps) < 128:
        raise ValueError("one code point changes the count by more than a byte holds")
    return bytes([x & 255 for x in steps])


def blocks(text: str) -> list[int]:
    """Cuts of a text, 0 and its length included, such that normalising goes block by block."""
    if text.isascii():
        return list(range(len(text) + 1))
    bound, combining = joining(), unicodedata.combining
    return [0, *(i for i in range(1, len(text)) if text[i] not in bound and not combining(text[i])), len(text)] if text else [0]


SHORT = (3, 2, 1)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else 256 upwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(later)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library, with or without an end-of-word suffix."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(self.vocab[a] << 24 | self.vocab[b], (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.normal, self.pre = self.library.normalizer, self.library.pre_tokenizer
        self.letters = byte_letters()
        self.as_letters = {b: c for b, c in enumerate(self.letters)}
        back = {c: b for b, c in enumerate(self.letters)}
        #: id -> the bytes it stands for; special tokens stand for their own string.
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocab.items() if not self.suffix and all(c in back for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.sizes = {i: len(s) - len(self.suffix) if self.suffix and s.endswith(self.suffix) else len(s) for s, i in self.vocab.items()}
        #: By its last four letters, how long a token can be, longest first: within words (0) and at their ends (1).
        self.lengths: tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]] = ({}, {})
        found: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for s, i in self.vocab.items():
            if s not in self.special and self.sizes[i] > 3:
                at_end = bool(self.suffix) and s.endswith(self.suffix)
                found[at_end].setdefault(s[self.sizes[i] - 4 : self.sizes[i]], set()).add(self.sizes[i])
        for own, known in zip(self.lengths, found, strict=True):
            own.update((end, (*sorted(sizes, reverse=True), 3, 2, 1)) for end, sizes in known.items())
        self.fits: dict[int, bool] = {}
        self.limit = limit
        self.kinds: dict[str, str] = {}
        self.tail: tuple[str, tuple[list[int], list[int]]] = ("", ([-1], [0]))
        self.words = Generations(self._merge_word, limit)
        self.counts = Generations(self.word_count, limit)
        self.word_steps = Generations(self._word_steps, limit)

    # --- pre-tokenising -------------------------------------------------------------------------------------------
    def pretokens(self, text: str) -> list[str | int]:
        """Byte-letter strings to be merged apart from each other; ints are special tokens found in the text."""
        plain = PLAIN.fullmatch(text)
        if plain:
            words = [w for w in plain.groups() if w]
            if self.normal:
                words = [w.lower().lstrip(" ") for w in words]  # Latin-1 letters: each stands for itself when lowered
            return [w if w.isascii() and w[0] != " " else w.encode().decode("latin-1").translate(self.as_letters) for w in words]
        out: list[str | int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.normal.normalize_str(part) if self.normal else part
                out += [p for p, _ in self.pre.pre_tokenize_str(part)]
        return out

    # --- operator 10: queue of ranks over a linked list ---------------------------------------------------------------
    def symbols(self, word: str) -> list[int]:
        """One id for each byte letter; the last carries the end-of-word suffix, where there is one."""
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge by rank, then from the left.

        ``ids`` with ``after`` and ``before`` is a doubly linked list; a heap entry is a rank above a place.  An entry is
        stale if the pair that now starts at its place no longer has its rank; such entries are skipped.
        """
        n = len(ids)
        if n < 2:
            return ids
        get, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [hit[0] << bits | i for i, hit in enumerate([get(a << 24 | b) for a, b in zip(ids, ids[1:])]) if hit]  # noqa: B905
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            entry = pop(heap)
            i = entry & low
            j, a = after[i], ids[i]
            if j == n or a < 0:
                continue
            hit = get(a << 24 | ids[j])
            if not hit or hit[0] != entry >> bits:
                continue
            ids[i] = made = hit[1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if new := get(made << 24 | ids[k]):
                    push(heap, new[0] << bits | i)
            h = before[i]
            if h >= 0 and (new := get(ids[h] << 24 | made)):
                push(heap, new[0] << bits | h)
        return [x for x in ids if x >= 0]

    def _merge_word(self, word: str) -> list[int]:
        return self.merge(self.symbols(word))

    def encode(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for w in self.pretokens(chunk):
            ids += [w] if isinstance(w, int) else self.words[w] if len(w) < 100 else self._merge_word(w)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    # --- operator 3: prefix dynamic programming ---------------------------------------------------------------------
    def inner_table(self, word: str, upto: int, known: tuple[list[int], list[int]] | None = None) -> tuple[list[int], list[int]]:
        """Of each prefix with no end-of-word suffix, by length in byte letters: last token and token count.

        An encoding is valid if each token merges to itself and neighbours stay apart, and just one is valid.  So the
        last token of a prefix is the one token that ends there and stays apart from the last token of the prefix in
        front of it: one table look-up a letter and length, no encoding anew.  ``known`` is the table of a prefix, which
        is gone on from.
        """
        get, fits, lengths = self.vocab.get, self.fits.get, self.lengths[0].get
        last, count = known or ([-1], [0])
        for i in range(len(last), upto + 1):
            for n in lengths(word[i - 4 : i], SHORT) if i > 3 else SHORT:
                start = i - n
                if start < 0 or (t := get(word[start:i])) is None:
                    continue
                ok = fits(last[start] << 24 | t) if start else fits(-t - 1)
                if ok or ok is None and self._learn(last[start] if start else -1, t, word, start, i, ""):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary lacks letters of {word!r}")
        return last, count

    def _finals(self, word: str, ends: list[int], last: list[int], count: list[int]) -> list[int]:
        """Token counts of prefixes of these lengths as texts of their own: their last tokens carry the suffix."""
        if not self.suffix:
            return [count[i] for i in ends]
        get, fits, lengths, suffix, out = self.vocab.get, self.fits.get, self.lengths[1].get, self.suffix, []
        for i in ends:
            for n in lengths(word[i - 4 : i], SHORT) if i > 3 else SHORT:
                start = i - n
                if start < 0 or (t := get(word[start:i] + suffix)) is None:
                    continue
                ok = fits(last[start] << 24 | t) if start else fits(-t - 1)
                if ok or ok is None and self._learn(last[start] if start else -1, t, word, start, i, suffix):
                    out.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary lacks letters of {word!r}")
        return out

    def _final(self, word: str, i: int, last: list[int], count: list[int]) -> int:
        return self._finals(word, [i], last, count)[0]

    def _learn(self, a: int, t: int, word: str, start: int, end: int, suffix: str) -> bool:
        """Does token t merge to itself, and stay apart from token a in front of it?"""
        if len(self.fits) > 4 * self.limit:
            self.fits.clear()
        vocab = self.vocab
        own = [vocab[c] for c in word[start : end - 1]] + [vocab[word[end - 1] + suffix]]
        if a < 0:
            ok = self.fits[-t - 1] = self.merge(own) == [t]
        else:
            front = [vocab[c] for c in word[start - self.sizes[a] : start]]
            ok = self.fits[a << 24 | t] = self.merge(front + own) == [a, t]
        return ok

    def prefix_counts(self, word: str, ends: list[int]) -> list[int]:
        """Token counts of those prefixes of one pre-token, each as a text of its own, that end at ``ends`` (byte letters)."""
        last, count = self.inner_table(word, ends[-1] if ends else 0)
        return self._finals(word, ends, last, count)

    def word_count(self, word: str) -> int:
        """The last entry of ``prefix_counts``."""
        n = len(word)
        last, count = self.inner_table(word, n - 1 if self.suffix else n)
        return self._final(word, n, last, count)

    def _shown_count(self, text: str) -> int:
        """Tokens of normalised text.  The table of the last long run is gone on from where a run begins with it."""
        total = 0
        for word, _ in self.pre.pre_tokenize_str(text):
            if len(word) < 100:
                total += self.counts[word]
                continue
            if not word.startswith(self.tail[0]):
                self.tail = ("", ([-1], [0]))
            table = self.inner_table(word, len(word), self.tail[1])
            self.tail = (word, table)
            total += self._final(word, len(word), *table)
        return total

    def letters_of(self, text: str) -> str:
        return text if text.isalnum() and text.isascii() else text.encode().decode("latin-1").translate(self.as_letters)

    def kind(self, c: str) -> str:
        """How the library takes a character: "l" and "s" go on in runs, "n" stands alone, "" is dropped."""
        found = self.kinds.get(c)
        if found is None:
            alone = lambda t: len(self.pre.pre_tokenize_str(t))
            found = self.kinds[c] = "" if not alone(c) else "l" if alone("a" + c) == 1 else "s" if alone("!" + c) == 1 else "n"
        return found

    def prefix_table(self, text: str) -> list[int]:
        """Token counts of all prefixes of a text as texts of their own, by length in code points; no prefix is encoded.

        Pre-tokens of the whole that end inside a prefix are pre-tokens of the prefix, too, so a prefix's count is that
        of the pre-tokens in front plus one entry of the table of the pre-token it cuts.  Looked at apart: special
        tokens, which cut are plain text; contractions, which cut are two pre-tokens; characters that normalising
        joins, which cut aren't joined.
        """
        out, done = [0], 0
        parts = self.apart.split(text) if self.apart else [text]
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            table = self._plain_table(parts[k] + special[:-1])
            out += [done + n for n in table[1:]]
            done += table[len(parts[k])]
            if special:
                done += 1
                out.append(done)
        return out

    def steps(self, text: str) -> bytes:
        """``prefix_table`` as steps, a signed byte a code point."""
        plain = PLAIN.fullmatch(text)
        if plain and self.normal and text[0] != " ":
            return b"".join([self.word_steps[w.lower()] for w in plain.groups() if w])
        return as_bytes(self.prefix_table(text))

    def _word_steps(self, word: str) -> bytes:
        ends = range(1, len(word) + 1) if word.isascii() else list(itertools.accumulate(len(c.encode()) for c in word))
        return as_bytes([0, *self.prefix_counts(self.letters_of(word), ends)])

    def _plain_table(self, text: str) -> list[int]:
        cuts = blocks(text)
        shown = [self.normal.normalize_str(text[i:j]) if self.normal else text[i:j] for i, j in zip(cuts, cuts[1:])]  # noqa: B905
        whole = "".join(shown)
        size = [len(c.encode()) for c in whole]
        at, run = [0] * (len(whole) + 1), [None] * (len(whole) + 1)  # count up to there; the run that reaches there
        done = upto = 0
        for letters, (a, b) in self.pre.pre_tokenize_str(whole):
            at[upto : a + 1] = [done] * (a + 1 - upto)
            if b - a > 1 and whole[a] == "'" and self.kind(whole[a + 1]) == "l":  # a contraction
                counts, table, ends = [self._shown_count(whole[a:i]) for i in range(a + 1, b + 1)], None, None
            else:
                ends = np.cumsum(size[a:b]).tolist()
                table = self.inner_table(letters, ends[-1])
                counts = self._finals(letters, ends, *table)
            for i, n in enumerate(counts):
                at[a + 1 + i], run[a + 1 + i] = done + n, (a, done, letters, table, ends)
            done, upto = done + counts[-1], b
        at[upto:] = [done] * (len(whole) + 1 - upto)
        out, q = [0], 0
        for i, j, own in zip(cuts, cuts[1:], shown):  # noqa: B905
            for k in range(i + 1, j):
                part = self.normal.normalize_str(text[i:k]) if self.normal else text[i:k]
                out.append(self._cut_block(whole, q, part, at, run))
            q += len(own)
            out.append(at[q])
        return out

    def _cut_block(self, whole: str, q: int, part: str, at: list[int], runs: list) -> int:
        """The count of ``whole[:q] + part``, where ``part`` is what is left of characters that the whole joins."""
        if runs[q] is None:
            return at[q] + self._shown_count(part)
        a, done, letters, table, ends = runs[q]
        run_before = runs[a]
        mark = a if whole[a] == "'" else a - 1 if run_before and run_before[0] == a - 1 and whole[a - 1] == "'" else -1
        if mark >= 0 and q - mark < 3:  # with part it may be a contraction, or no longer one
            return (done if mark == a else run_before[1]) + self._shown_count(whole[mark:q] + part)
        kind = self.kind(whole[q - 1])
        own = next((i for i, c in enumerate(part) if self.kind(c) != kind), len(part)) if kind in ("l", "s") and table else 0
        if not own:
            return at[q] + self._shown_count(part)
        upto = ends[q - a - 1]
        word = letters[:upto] + self.letters_of(part[:own])
        last, count = self.inner_table(word, len(word), (table[0][: upto + 1], table[1][: upto + 1]))
        return done + self._final(word, len(word), last, count) + (self._shown_count(part[own:]) if own < len(part) else 0)

    def count(self, chunk: str) -> int:
        """Tokens of a chunk by the prefix tables."""
        return sum(1 if isinstance(w, int) else self.counts[w] if len(w) < 100 else self.word_count(w) for w in self.pretokens(chunk))

    def trim(self) -> None:
        self.words.trim()
        self.counts.trim()
        self.word_steps.trim()


def space_chunks(data: bytes) -> list[bytes]:
    """Chunks in front of white space, each with the white space before it (for vocabularies that keep spaces)."""
    if MIXED.search(data):
        return [x.encode() for x in RUNS.findall(data.decode("utf-8", "replace"))]
    first, *rest = data.split(b" ")
    return ([first] if first else []) + [b" " + x for x in rest]
