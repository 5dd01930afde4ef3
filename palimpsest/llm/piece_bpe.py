"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For each prefix of a text there is one last token of its encoding. It is found among the pieces that an
Aho-Corasick automaton matches at the prefix's end: the one that is pair-compatible with the last token of the
prefix before it, i.e. merging the two pieces' characters gives the two pieces back. The ids are then read
backwards through the table. Characters without a piece become byte pieces, which never merge.

A text is cut where no piece of the vocabulary reaches across, and a worker keeps the ids of such parts, and the text that
these decode to, in a bounded memory. A batch's texts are cut together, and each of its different parts is looked up once.

Defined cases: null counts as empty and gives the end id alone; a text with U+2581 decodes to one with a space there, as in
the library; rows that repeat an id, a null one included, each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, emit

SPACE = "▁"
MARK = SPACE.encode()
#: Full-width, ligature, combined and control characters and spaces, which a model without normalisation leaves as they are.
PROBE = "\uff21 \ufb01  A\u0301 \u2460\u200b\t\u3000 x "
MODELS: dict[str, "PieceModel"] = {}
#: Parts and runs that a worker keeps, and the characters of the longest run and bytes of the longest part, so that what is kept has a bound in bytes.
CACHE_SIZE, LONG = 600_000, 64


class PieceModel:
    """The pieces of a model file: their ids and scores, the automaton, and the memory of compatible pairs."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model file changes text before it is encoded; only models without normalisation are read")
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        #: A piece's id as it is written, and what that decodes to.
        self.written = {p: (str(i).encode(), p.replace(SPACE, " ")) for p, i in self.ids.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes_)}
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.runs: dict[str, tuple[bytes, str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.ids:
            if self.merge(p) == [p]:  # a piece that merging can make at all
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: Characters that stand next to each other inside a piece; between all others texts can be cut.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.across = any(x[1] == SPACE != x[0] or "\n" in x for x in self.inner)

    def merge(self, text: str) -> list[str]:
        """Merges by best score, leftmost first: what defines compatibility (and the tests' brute force)."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            if len(parts) == 2:
                self.halves[text] = parts[0], parts[1]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces gives the two back."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE_SIZE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right] if SPACE * 2 in left + right else self.apart(left, right)
        return known

    def apart(self, left: str, right: str) -> bool:
        """The same by undoing merges, the latest first: at no time may a merge across be due before the next one inside.

        It takes a piece to rank after its halves, which runs of spaces do not.
        """
        rank, never = self.rank, (math.inf, 0)
        due = never
        while True:
            across = rank.get(left + right)
            if across is not None and (across, 1) < due:
                return False
            a, b = (rank[left] if len(left) > 1 else -1), (rank[right] if len(right) > 1 else -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal ranks the left one is first
                due, left = (a, 1), self.halves[left][1]
            else:
                due, right = (b, 2), self.halves[right][0]

    def tokens(self, run: str) -> list[str]:
        """The encoding of a run of characters that are all pieces, by its prefix table."""
        last: list[str | None] = [None] * (len(run) + 1)
        pairs = self.pairs
        for end, piece in self.automaton.iter(run):
            end += 1
            if last[end] is None:
                before = end - len(piece)
                if not before:
                    last[end] = piece
                elif (previous := last[before]) is not None:
                    known = pairs.get((previous, piece))
                    if known or known is None and self.compatible(previous, piece):
                        last[end] = piece
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def of_run(self, run: str) -> tuple[bytes, str]:
        """Decimal ids joined by spaces, and what they decode to, of characters that are all pieces, or of one that is none."""
        if len(run) == 1 and run not in self.ids:
            ids = [self.bytes_[b] for b in run.encode()]
            return " ".join(map(str, ids)).encode(), self.text_of(ids)
        found = [self.written[t] for t in self.tokens(run)]
        return b" ".join([x[0] for x in found]), "".join([x[1] for x in found])

    def of_part(self, part: str) -> tuple[bytes, str]:
        """The same of a part, which is cut further wherever no piece reaches across."""
        inner, runs, at, out = self.inner, self.runs, 0, []
        for k in [k for k, pair in enumerate(map(add, part, part[1:]), 1) if pair not in inner] + [len(part)]:
            run = part[at:k]
            at = k
            if (known := runs.get(run)) is None:
                if len(runs) > CACHE_SIZE:
                    runs.clear()
                known = self.of_run(run)
                if len(run) <= LONG:
                    runs[run] = known
            out.append(known)
        return (out[0] if len(out) == 1 else (b" ".join([x[0] for x in out]), "".join([x[1] for x in out])))

    def entry(self, part: bytes) -> tuple[bytes, bytes, int]:
        """A part's decimal ids, each with a space after it, what they decode to in UTF-8, and their number; from memory where it is known."""
        if (known := self.parts.get(part)) is None:
            ids, decoded = self.of_part(part.decode().replace(" ", SPACE))
            known = ids + b" ", decoded.encode(), ids.count(b" ") + 1
            if len(part) <= LONG:
                if len(self.parts) > CACHE_SIZE:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def starts_of(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where parts begin in the bytes of texts that begin at firsts: spaces with the word after them, spaces before a line's end, and line ends by themselves."""
        new = np.zeros(len(data), bool)
        new[firsts] = True
        if not self.across:
            line, space = data == 10, data == 32
            new |= line
            new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        return np.flatnonzero(new)

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[memoryview, memoryview, int]]:
        """Of each text, in UTF-8, the decimal ids with a space after each, without an end id, the text that they decode to, and the number of ids.

        Texts are cut into parts all at once, each different part is looked up once, and Arrow puts the parts' ids and texts together.
        """
        # Encoding puts a space before a text that isn't empty, and U+2581 is how it writes spaces.
        marked = [b" " + t.replace(MARK, b" ") if t else t for t in texts]
        sizes = np.array([*map(len, marked)], np.int64)
        data, ends = b"".join(marked), np.cumsum(sizes)
        starts = self.starts_of(np.frombuffer(data, np.uint8), (ends - sizes)[sizes > 0])
        places = pa.py_buffer(np.append(starts, len(data)))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
        found = [self.entry(p) for p in parts.dictionary.to_pylist()]
        totals = np.append(0, np.cumsum(np.array([x[2] for x in found], np.int64)[parts.indices.to_numpy()]))
        joined = []
        for k in range(2):
            made = pa.array([x[k] for x in found], pa.large_binary()).take(parts.indices)
            offsets = np.frombuffer(made.buffers()[1], np.int64, len(starts) + 1) if len(starts) else np.zeros(1, np.int64)
            joined.append((memoryview(made.buffers()[2] or b"").cast("B"), offsets))
        at = np.searchsorted(starts, np.append(0, ends))
        for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            (ids, decoded) = (content[offsets[low] : offsets[high]] for content, offsets in joined)
            yield ids, decoded[1:] if decoded[:1] == b" " else decoded, int(totals[high] - totals[low])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Decimal ids joined by spaces, without an end id, and the text that they decode to."""
        ((ids, decoded, _),) = self.encode_all([text.encode()])
        return bytes(ids).rstrip(), str(decoded, "utf-8")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        return self.text_of(ids).removeprefix(" ")

    def text_of(self, ids: list[int]) -> str:
        """Byte pieces are joined into characters, control pieces are empty."""
        out, kept = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                kept.append(b)
                continue
            if kept:
                out.append(kept.decode("utf-8", "replace"))
                kept.clear()
            if i not in self.control:
                out.append(self.pieces[i] if i != self.unknown else " ⁇ ")
        if kept:
            out.append(kept.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


def model_at(path: str) -> PieceModel:
    if path not in MODELS:
        MODELS[path] = PieceModel(path)
    return MODELS[path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); the ids end with the model's end id. ids is null unless asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        end = str(model.end).encode()
        for batch in batches:
            columns: list[list] = [batch.column("doc_id"), *([] for _ in range(4))]
            for ids, decoded, n in model.encode_all(bytes_of(batch, "text")):
                digest = hashlib.sha256(ids)
                digest.update(end)
                values = n + 1, str(ids, "ascii") + end.decode() if with_ids else None, digest.hexdigest(), hashlib.sha256(decoded).hexdigest()
                for column, value in zip(columns[1:], values, strict=True):
                    column.append(value)
            yield emit(schema, columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, ids_sha256 string, decoded_sha256 string")
