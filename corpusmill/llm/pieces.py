"""SentencePiece encoding and decoding: Viterbi over the matches of an Aho-Corasick automaton.

The automaton holds the model's pieces. It passes over the text once; at each position its output links give all
pieces that end there, longest first, and each relaxes the best score of that position. A character that no piece of
one character covers costs 10 more than the worst piece and becomes its UTF-8 bytes' pieces. Scores are the model's;
sums are taken in doubles and ties go to the longer last piece.

No piece holds a word mark after another character, nor a line feed, so a text falls apart there into strings whose
best paths don't touch; each worker remembers the ids of strings it has met. A literal U+2581 in a text is written as
its bytes, so that decoding gives back every text exactly.

Defined cases: a null text counts as empty and has no ids; repeated rows each get their row; an empty table gives an
empty result; ids that the model doesn't have raise an error in decoding.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .shared import free_name, small_batches, table

MARK = "▁"
#: Strings in a generation of those that a worker remembers.
CACHE = 100_000
#: What a character without a piece costs beside the worst piece.
UNKNOWN_PENALTY = 10.0


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Known(dict):
    """The packed ids of strings, made when first asked for; of two generations, the older one goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, s: str) -> bytes:
        found = self.older.get(s)
        if found is None:
            found = _packed(self.make(s))
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        self[s] = found
        return found


class Pieces:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no piece for each byte")
        self.automaton, self.single = ahocorasick.Automaton(), set()
        for i in plain:
            name = self.names[i]
            self.automaton.add_word(name, (i, len(name), float(sp.get_score(i))))
            if len(name) == 1:
                self.single.add(name)
        self.automaton.make_automaton()
        self.unknown = min((float(sp.get_score(i)) for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[list(self.byte_of)] = True
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", self.names[i]) or "\n" in self.names[i] for i in plain)
        self.known = _Known(self.viterbi)
        self.mark, self.feed = _packed(self._bytes(MARK)), _packed(self._bytes("\n"))

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path over s, whose spaces are marks."""
        n = len(s)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        odd = [i for i, c in enumerate(s) if c not in self.single]
        matches = self.automaton.iter(s)
        if odd:  # these characters also make a step of their own, after the pieces that end with them
            matches = sorted([*((end, 0, x) for end, x in matches), *((i, 1, (-1, 1, self.unknown)) for i in odd)], key=lambda m: m[:2])
            matches = ((end, x) for end, _, x in matches)
        for end, (piece, length, score) in matches:
            start = end + 1 - length
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (start, piece)
        out, at = [], n
        while at:
            start, piece = back[at]
            out += [piece] if piece >= 0 else self._bytes(s[start:at])[::-1]
            at = start
        return out[::-1]

    def _line(self, s: str) -> bytes:
        """s has spaces; it may begin with the mark of the text's begin."""
        if not self.apart:
            return _packed(self.viterbi(s.replace(" ", MARK)))
        if "  " in s or s[:1] == " ":
            parts = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", s.replace(" ", MARK))
        else:
            first, *rest = s.split(" ")
            parts = [first, *[MARK + x for x in rest]]
        return b"".join(map(self.known.__getitem__, parts))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        out: list[bytes] = []
        for i, run in enumerate(text.split(MARK)):
            if i:
                out.append(self.mark)
            for j, line in enumerate(run.split("\n") if self.apart else [run]):
                if j:
                    out.append(self.feed)
                if not i and not j:
                    # The mark before the text joins a text that begins with spaces: as many marks, and one more.
                    out.append(self._line(" " + line) if line[:1] == " " or not line else self._line(MARK + line))
                elif line:
                    out.append(self._line(line))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            out.append(self.names[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)[1:]


_MODELS: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _MODELS:
        _MODELS[model] = Pieces(model)
    return _MODELS[model]


def encode(docs: DataFrame, model: str, name: str = "ids") -> DataFrame:
    """The columns of docs without text, and the ids in a column name (array of int); a column of that name must not be there."""
    small_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in rest]
    if free_name(names, name) != name:
        raise ValueError(f"there is a column {name} already")

    def run(batches):
        sp = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array([sp.encode(t) for t in part.column(len(names)).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), ids], names=[*names, name])

    return docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").cast("string").alias("text")).mapInArrow(run, StructType([*rest, StructField(name, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, model: str, name: str = "ids") -> DataFrame:
    """doc_id and text from doc_id and the ids in the column name."""

    def run(batches):
        sp = pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sp.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{name}`").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip: decoding the ids gives the text."""

    def run(batches):
        sp = pieces(model)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = sp.encode(text)
                rows.append((doc_id, len(ids), int(sp.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), sp.decode(ids.tolist()) == (text or "")))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.bool_()])], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
