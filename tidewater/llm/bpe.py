"""SentencePiece encoding and decoding, exact for merge-type (BPE) models.

Merging one pair at a time gives the only token sequence in which every two neighbours,
taken alone, merge back into just these two. So a text is encoded from the left by the
longest matches of an Aho-Corasick automaton: a match is taken if it is compatible with
the token before it, and where none is, the search goes back one token. Each prefix has
one valid sequence, so a bitfield of positions that led nowhere bounds the work.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks and pairs of tokens that a Python worker keeps, and the longest chunk; when as many are kept, it begins anew.
CACHED_CHUNKS, CACHED_PAIRS, CACHED_CHARS = 300_000, 500_000, 48

#: Texts that other normalizers or model types treat otherwise: runs of spaces, wide, composed and control characters.
PROBES = ("", " ", "a", "  two  spaces ", "tab\tline\nend", "Ａ①ﬁ", "e\u0301é", "it's 12.5%, no?", "\u200bx\u00a0y", "漢字😀")

#: The characters of \w that are neither letters nor decimal digits, for a character class.
_NUMBERS = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


class BpeModel:
    """A merge-type model whose normalization is: one space in front, spaces written as SPACE."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in kept}
        self.id_texts = {p: str(i) for p, i in self.ids.items()}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in kept}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.pieces = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        # Without a piece that has SPACE after another character no merge crosses such a place,
        # and without one that has a line break beside another character none crosses that.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = "".join(c for c in "\n\r\t" if not any(c in p and p != c for p in self.ids))
        word = f"[^{SPACE}{breaks}]"
        # Nor does one cross from a letter to a mark that no piece has behind a letter. Numbers such as ² are no letters here.
        behind = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and c not in behind)
        plain = f"{SPACE}*[^\\W\\d_]++(?=[{marks}])(?<![{_NUMBERS}])|" if marks else ""
        self._chunks = re.compile(r".+" if inner else f"{plain}{SPACE}+{word}*|{word}+" + (f"|[{breaks}]" if breaks else ""), re.DOTALL).findall
        self._pairs: dict[tuple[str, str], bool] = {}
        self._kept: dict[str, tuple[int, str, str]] = {}
        self.alone = lru_cache(1 << 16)(lambda a: self.merge(a) == [a])
        for probe in PROBES:
            if self.encode(probe) != model.encode(probe):
                raise ValueError(f"{path} does not encode {probe!r} as a merge-type model does that only puts one space in front")

    def compatible(self, a: str, b: str) -> bool:
        """Do two tokens stay apart when their text is merged anew?"""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def merge(self, text: str) -> list[str]:
        """Merge by definition: the best-scored neighbours first, of equal ones the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tokens(self, text: str) -> list[str]:
        """The tokens of a normalized text; characters outside the vocabulary stand alone."""
        ids, compatible = self.ids, self.compatible
        if text in ids and self.alone(text):
            return [text]
        out, pos = [], 0
        for end, length in self.automaton.iter_long(text):  # the longest match at each place, as long as no place is left out
            end += 1
            token = text[pos:end]
            if end - pos != length or not (compatible(out[-1], token) if out else self.alone(token)):
                break
            out.append(token)
            pos = end
        else:
            if pos == len(text):
                return out
        return self._search(text, out, pos)

    def _search(self, text: str, out: list[str], pos: int) -> list[str]:
        """Go on from the tokens so far by all matches at each place, going back where none is compatible."""
        ids, compatible = self.ids, self.compatible
        n, matches = len(text), list(self.automaton.iter(text))
        longest = [1] * n
        for end, length in matches:  # ends ascend, so the longest match at a place comes last
            longest[end - length + 1] = length
        lengths: list[list[int]] = []  # all matches at each place, for when the longest does not do
        failed = bytearray(n // 8 + 1)  # it has a bit for each position that led nowhere
        while pos < n:
            to = pos + longest[pos]
            if not failed[to >> 3] >> (to & 7) & 1:
                token = text[pos:to]
                if compatible(out[-1], token) if out else self.alone(token):
                    out.append(token)
                    pos = to
                    continue
            if not lengths:
                lengths = [[] if c in ids else [1] for c in text]
                for end, length in matches:
                    lengths[end - length + 1].append(length)
            for length in lengths[pos][-2::-1]:
                to = pos + length
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                token = text[pos:to]
                if compatible(out[-1], token) if out else self.alone(token):
                    out.append(token)
                    pos = to
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
        return out

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        tokens, texts = self.tokens(chunk), self.id_texts
        try:
            return len(tokens), ",".join([texts[t] for t in tokens]), "".join(tokens).replace(SPACE, " ")
        except KeyError:  # a character outside the vocabulary
            found: list[int] = []
            for t in tokens:
                i = self.ids.get(t)
                found += [i] if i is not None else [self.byte_ids.get(b, self.unknown) for b in t.encode()]
            return len(found), ",".join(map(str, found)), self._join(found)

    def _parts(self, text: str) -> list[tuple[int, str, str]]:
        normal = SPACE + text.replace(" ", SPACE) if text else ""
        kept, out = self._kept, []
        for c in self._chunks(normal):
            found = kept.get(c)
            if found is None:
                found = self._chunk(c)
                if len(c) <= CACHED_CHARS:
                    if len(kept) >= CACHED_CHUNKS:
                        kept.clear()
                    kept[c] = found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self._parts(text) for i in p[1].split(",")]

    def _join(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_text(raw))
                raw = bytearray()
            out.append(self.pieces.get(i, " ⁇ " if i == self.unknown else ""))
        return "".join([*out, _text(raw)])

    def decode(self, ids: list[int]) -> str:
        text = self._join(ids)
        first = next((i for i in ids if i in self.pieces or i in self.bytes or i == self.unknown), None)
        return text[1:] if self.pieces.get(first, "").startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text: decode(encode(text)) by chunks.

        Bytes of one character never lie in two chunks, so chunks decode by themselves.
        """
        if not text:
            return 0, "", ""
        counts, ids, decoded = zip(*self._parts(text), strict=True)
        return sum(counts), ",".join(ids), "".join(decoded)[1:]


def _text(raw: bytearray) -> str:
    """Bytes as text, each byte that is not part of valid UTF-8 as one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@lru_cache(4)
def load(path: str) -> BpeModel:
    """One model per Python worker, with what its caches hold."""
    return BpeModel(path)


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row; a null or empty text has no ids. Extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            ids = pa.array([model.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def detokenize(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give null, and control ids give no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            text = pa.array([None if x.as_py() is None else model.decode(x.as_py()) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Ids are hashed as decimals joined by commas, decoded text in UTF-8. A null text counts
    as empty: no ids, and both digests are those of nothing. Rows are independent: nothing
    is shuffled, repeated rows and null ids stay as they are. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            found = [model.digest(t.as_py() or "") for t in b.column(1)]
            hashes = [[sha256(f[i].encode()).hexdigest() for f in found] for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), *(pa.array(h, pa.string()) for h in hashes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
