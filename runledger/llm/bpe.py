"""BPE encoding by longest matches with backtracking, decoding by an offset table.

Aho-Corasick finds every vocabulary entry inside a word in one pass. The encoder walks left to
right taking the longest entry that starts where the last one ended; a neighbour pair is
allowed only if merging the two entries' texts by rank would leave exactly this border, which a
memo of pair checks answers. When no entry fits, it steps back and takes a shorter one. Each
position is given up at most once, so time is linear, and the result equals that of the merges.

The vocabulary is a file in the format of the tokenizers library: NFC, white space to one space, lower
case; a split pattern; byte-level characters; entries that end a word carry a suffix. Nothing
is trained here. The file's path is a parameter; executors read it by that path.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a task whose codes are remembered at once.
CACHE_WORDS = 200_000
FITS_PAIRS = 300_000
#: The Unicode property White_Space, as a character class's content.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def latin(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters only, its Unicode classes written out, for the faster module."""
    chars = [chr(c) for c in range(256)]
    classes = {rf"\p{{{k}}}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN"}
    for name, chars_of in {**classes, r"\s": _WHITE}.items():
        pattern = pattern.replace(name, chars_of)
    return re.compile(pattern.replace("[[", "[").replace("]]", "]"))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Words hold no white space, so runs of it need not be replaced first; \s of both modules would
        # take some control characters for white space too.
        self._split = regex.compile(split.replace(r"\s", _WHITE))
        self._split_latin = latin(split)
        self._build([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        texts = ["" for _ in range(max([*self.vocab.values(), *self.specials.values()]) + 1)]
        for t, i in [*self.vocab.items(), *self.specials.items()]:
            texts[i] = t
        blobs = [(t + " ").encode() for t in texts]
        self.lengths = np.array([len(b) for b in blobs], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        self._cache: dict[str, bytes] = {}

    def _signs(self, token: str) -> str:
        """A token as a string with one sign per byte; a byte that ends a word has a sign of its own."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + 0x1000)
        return token

    def _build(self, merges: list[tuple[str, str]]) -> None:
        """Entries numbered by rank: single signs first, then one for each merge."""
        single = [t for t in self.vocab if len(self._signs(t)) == 1]
        number = {t: i for i, t in enumerate(single)}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(single))]
        self.merged: dict[tuple[int, int], int] = {}
        names = list(single)
        for a, b in merges:
            body = a[: -len(self.suffix)] if self.suffix and a.endswith(self.suffix) else a
            t = body + b
            if a not in number or b not in number or t in number or t not in self.vocab:
                continue
            number[t] = len(names)
            self.merged[number[a], number[b]] = len(names)
            self.split.append((number[a], number[b]))
            names.append(t)
        self.code = np.array([self.vocab[t] for t in names], dtype="<u4")
        signs = [self._signs(t) for t in names]
        self.size = [len(s) for s in signs]
        self._fits: dict[int, bool] = {}
        # An entry that its own merges don't lead to can't come out of any text.
        self.real: list[bool] = []
        for i, (a, b) in enumerate(self.split):
            self.real.append(a == i or self.real[a] and self.real[b] and self._kept_apart(a, b, i))
        real = [i for i, ok in enumerate(self.real) if ok]
        self.matcher = ahocorasick.Automaton()
        for i in real:
            self.matcher.add_word(signs[i], i)
        self.shorter = [-1] * len(names)
        by_signs = {signs[i]: i for i in real}
        for i in real:
            for n in range(self.size[i] - 1, 0, -1):
                if (j := by_signs.get(signs[i][:n])) is not None:
                    self.shorter[i] = j
                    break
        self.matcher.make_automaton()
        chars = byte_characters()
        self._inner = str.maketrans({b: chars[b] for b in range(256)})
        self._last = [chr(ord(c) + 0x1000) if self.suffix else c for c in chars]

    def fits(self, a: int, b: int) -> bool:
        """Would merging by rank keep a border between entries a and b? Answers are remembered."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > FITS_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._kept_apart(a, b, len(self.split))
        return known

    def _kept_apart(self, a: int, b: int, bound: int) -> bool:
        """No merge over the border between a and b comes before the entry numbered ``bound`` is made.

        Both are taken apart from the border outwards, the later merge first; if a pair seen on the
        way merges before the parts around it do, the border would have been merged over.
        """
        while True:
            pair = self.merged.get((a, b))
            if pair is not None and pair < bound:
                return False
            left, right = self.split[a], self.split[b]
            open_left, open_right = left[0] != a, right[0] != b
            if open_left and (a > b or not open_right):
                bound, a = a, left[1]
            elif open_right:
                bound, b = b + 1, right[0]
            else:
                return True

    def encode_word(self, word: str) -> bytes:
        """Codes of one word as little-endian 32-bit integers."""
        raw = word.encode()
        signs = raw[:-1].decode("latin-1").translate(self._inner) + self._last[raw[-1]]
        # The longest entries one after another are the answer if all neighbours fit.
        fits, known = self.fits, self._fits
        out = [i for _, i in self.matcher.iter_long(signs)]
        before = out[0]
        for i in out[1:]:
            ok = known.get(before << 32 | i)
            if not (fits(before, i) if ok is None else ok):
                return self._backtrack(signs)
            before = i
        return self.code[out].tobytes()

    def _backtrack(self, signs: str) -> bytes:
        n, size, shorter, fits = len(signs), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, i in self.matcher.iter(signs):
            longest[end + 1 - size[i]] = i  # later ends are longer
        open_at = [True] * (n + 1)
        out: list[int] = []
        at, take = 0, longest[0]
        while at < n:
            while take >= 0:
                end = at + size[take]
                if open_at[end] and (not out or fits(out[-1], take)):
                    break
                take = shorter[take]
            if take >= 0:
                out.append(take)
                at = end
                take = longest[at] if at < n else -1
            else:
                open_at[at] = False
                take = out.pop()
                at -= size[take]
        return self.code[out].tobytes()

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: no final sigma.
        text = text.replace("\u03a3", "\u03c3").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._split.findall(text)
        return self._split_latin.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text; texts of special tokens in it become their codes, as the library does by default."""
        cache, parts = self._cache, []
        at = 0
        for m in self._special.finditer(text) if self._special and "<|" in text else ():
            parts += [self._encode_plain(text[at : m.start()], cache), np.array([self.specials[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        parts.append(self._encode_plain(text[at:] if at else text, cache))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def _encode_plain(self, text: str, cache: dict[str, bytes]) -> bytes:
        words = self._words(text)
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.encode_word(w)
        return b"".join([cache[w] for w in words])

    def decode(self, codes: np.ndarray) -> bytes:
        """Entries' texts parted by spaces, in UTF-8, gathered from one table by offset and length."""
        if not len(codes):
            return b""
        out = []
        for a in range(0, len(codes), 1 << 17):
            part = codes[a : a + (1 << 17)].astype(np.int64)
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(self.offsets[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder for each file and process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of codes). Null is an empty text and has no codes."""
    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                ids = [bpe.encode(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                flat = pa.array(np.concatenate(ids), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                texts = [bpe.decode(np.asarray(x or [], dtype=np.int64)).decode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes whole texts and decodes the codes in the same pass. Null counts as empty; repeated rows
    each give a row; an empty table gives an empty result; other columns are not read.
    """
    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                n, ids, decoded = [], [], []
                for t in part.column(1).to_pylist():
                    codes = bpe.encode(t or "")
                    n.append(len(codes))
                    ids.append(hashlib.sha256(codes.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(codes)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
