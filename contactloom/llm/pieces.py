"""SentencePiece encoding of merge-type models by backtracking, and decoding.

Aho-Corasick gives the longest piece at every place. Pieces are put down from
the left; a piece may follow another only if merging the two texts anew gives
just these two. Where no piece fits, the last one is taken back, the place is
marked as failed in a bit field, and the next shorter piece is tried. The
result is the one sequence whose neighbours all fit, which is what merging the
whole text step by step gives.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import arrow_schema, one_column, slices

SPACE = "▁"
# Fixed value: what an unknown id reads as.
UNKNOWN = " ⁇ "
# Remembered results per task: short segments, and pairs of pieces. Beyond it they are worked out anew.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48
COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """A merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        self.end = model.eos_id()
        self.texts = [model.id_to_piece(i) for i in size]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in size]
        self.controls = {i for i in size if model.is_control(i)}
        self.texts[model.unk_id()] = UNKNOWN
        self.bytes = {i: int(self.texts[i][3:5], 16) for i in size if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.ids = {self.texts[i]: i for i in size if not special[i]}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece goes on after a space: words can't be encoded one by one")
        if any(c not in self.ids for t in self.ids for c in t):
            raise ValueError("a piece has a character that is no piece")
        self._known: dict[str, tuple[int, ...]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str | None] = {}  # a piece each at most
        # A piece that merging never reaches can't be put down.
        self.automaton = ahocorasick.Automaton()
        self.usable = {t for t in self.ids if len(t) == 1 or self.merged(t) == [t]}
        for t in self.usable:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        joined = {c for t in self.ids if len(t) > 1 for c in t}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        # Spaces with the word after them; ASCII characters that no longer piece has stand alone.
        self.segments = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + f"|[{alone}]" * bool(alone))

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost of equals; for short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            pairs = [(scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
            if not pairs:
                break
            i = -max(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged anew."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            known = self.merged(left + right) == [left, right]
            if len(self._fits) < REMEMBERED:
                self._fits[key] = known
        return known

    def shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper beginning of this one."""
        known = self._shorter.get(piece, piece)
        if known is piece:
            known = next((p for n in range(len(piece) - 1, 0, -1) if (p := piece[:n]) in self.usable), None)
            self._shorter[piece] = known
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text; an unknown character stands alone and fits everywhere."""
        size, known = len(text), self._fits
        longest = [1] * size
        for end, n in self.automaton.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        failed = bytearray(size // 8 + 1)
        done: list[str] = []
        at, last, piece = 0, None, text[: longest[0]] if text else None
        while at < size:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = True if last is None else known.get((last, piece))
                    if fit or fit is None and self.fits(last, piece):
                        break
                piece = self.shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                taken = done.pop()
                at -= len(taken)
                piece = self.shorter(taken)
                last = done[-1] if done else None
            else:
                done.append(piece)
                at, last = end, piece
                if at < size:
                    piece = text[at : at + longest[at]]
        return done

    def _segment(self, text: str) -> tuple[int, ...]:
        known = self._known.get(text)
        if known is None:
            out: list[int] = []
            for piece in self.split(text):
                if piece in self.ids:
                    out.append(self.ids[piece])
                else:
                    out.extend(self.byte_ids[b] for b in piece.encode())
            known = tuple(out)
            if len(self._known) < REMEMBERED and len(text) <= LONGEST_REMEMBERED:
                self._known[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, the end id last; null is empty.

        No piece goes on after a space, so nothing merges from a word's last
        character into the space after it: stretches of spaces with the word
        that follows are encoded one by one, and so are characters that are
        part of no longer piece.
        """
        out: list[int] = []
        if text:
            known = self._known
            for part in self.segments.findall(SPACE + text.replace(" ", SPACE)):
                out += known.get(part) or self._segment(part)
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, runs of byte ids are read as UTF-8, one leading space goes."""
        out: list[str] = []
        texts, held, first = self.texts, bytearray(), True
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                first = False
                continue
            if held:
                out.append(_readable(bytes(held)))
                held.clear()
            if i not in self.controls:
                out.append(texts[i][1:] if first and texts[i][:1] == SPACE else texts[i])
                first = False
        if held:
            out.append(_readable(bytes(held)))
        return "".join(out).replace(SPACE, " ")


def _readable(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that can't be read."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """The model of this file, loaded once per Python process."""
    return Pieces(path)


def encode_documents(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them.

    ``path`` is the model file, at the same place on every machine. With
    ``keep_ids`` the ids and the decoded text follow. A null text is empty: the
    end id alone. Repeated rows get equal results; an empty table gives an empty one; other columns are left out.
    A very long text is one row, encoded whole. Moves no rows.
    """
    docs = one_column(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}" + ", ids array<int>, decoded string" * keep_ids
    out = arrow_schema(schema)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [model.encode(t) for t in part.column("text").to_pylist()]
                decoded = [model.decode(x) for x in ids]
                columns = [
                    part.column("doc_id").cast(out.field(0).type),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ]
                if keep_ids:
                    columns += [pa.array(ids, out.field("ids").type), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, schema)
