"""Operator 1: SentencePiece encoding and decoding on the ``tokenizers`` backend.

The model's protobuf is parsed here, and its parts are rebuilt as a ``tokenizers`` pipeline: the normaliser (compiled
character map, white-space folding, dummy prefix, metaspace marker), the model (unigram scores, or the merges that a
BPE model's scores imply), byte fallback and the decoder. Texts are encoded in multithreaded batches inside Spark's
Arrow tasks. Parity with SentencePiece is verified while encoding: no piece of such a model holds the marker behind
another character, so ids of a text are the ids of its marker-led words, and each word that a task has not seen is
compared with SentencePiece itself. Texts with a differing word (ties between merges of one score) take SentencePiece's
ids and are counted in ``n_repaired``.

Defined cases: null and empty texts have no ids and decode to the empty text; rows are kept one by one, so repeated rows
and ids stay; other columns pass through unless they carry an output column's name, which the output then replaces;
texts beyond ``PART_BYTES`` are encoded in parts cut in front of spaces, which changes no id.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts are handed to the encoder in batches of about so many bytes, and longer texts in parts of this size.
PART_BYTES = 1 << 18
#: Words that a worker remembers: beyond it the table becomes the older one, words used again move over from there, and the
#: others are forgotten (and, when they come back, encoded and compared again). Twice as many are held at most.
SEEN_WORDS = 100_000


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (field number, value) pairs of one protobuf message: ints, 4- or 8-byte strings, or byte strings."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"not a protobuf message: wire type {kind}")
                size = varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What the protobuf of a SentencePiece model says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        m = PieceModel()
        for number, value in proto_fields(data):
            if number == 1:
                own = dict(proto_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                m.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(proto_fields(value))
                m.kind, m.byte_fallback, m.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
                m.space_suffix = bool(own.get(24, 0))
            elif number == 3:
                own = dict(proto_fields(value))
                m.charsmap = own.get(2, b"")
                m.dummy_prefix, m.squeeze_spaces, m.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return m

    def check(self) -> None:
        """Refuse what the rebuilt pipeline would not encode alike."""
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if self.space_suffix or not self.escape_spaces:
            raise ValueError("models with the space marker as a suffix or without it are not supported")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")

    @property
    def words_stand_alone(self) -> bool:
        """No piece holds the marker behind another character: a marker after a letter always starts a new piece."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)


def merges_of(m: PieceModel) -> list[tuple[str, str]]:
    """A BPE model's merges: every split of a piece into two pieces, best score first, then the longest left part."""
    known = {p for p, _, kind in m.pieces if kind == NORMAL}
    found = []
    for p, score, kind in m.pieces:
        if kind == NORMAL and len(p) > 1:
            for cut in range(len(p) - 1, 0, -1):
                if p[:cut] in known and p[cut:] in known:
                    found.append((-score, len(found), p[:cut], p[cut:]))
    found.sort()
    return [(a, b) for _, _, a, b in found]


def rebuild_normaliser(m: PieceModel):
    """The model's normaliser: compiled character map, white-space folding, dummy prefix, then the space marker."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Replace(Regex(r"^ +| +$"), ""), normalizers.Replace(Regex(" +"), " ")]
    steps += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def rebuild(m: PieceModel):
    """The model and decoder as a ``tokenizers`` pipeline; its input is normalised text."""
    from tokenizers import Tokenizer, decoders, models

    m.check()
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(
            vocab=vocab, merges=merges_of(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback
        )
    else:
        low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0) - 10
        model = models.Unigram(
            [(p, s if kind == NORMAL else low) for p, s, kind in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback
        )
    t = Tokenizer(model)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Codec:
    """One model in one Python worker. Words and their ids are remembered, so each distinct word is encoded once."""

    def __init__(self, data: bytes, threads: int):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        import sentencepiece

        self.model, self.threads = PieceModel.parse(data), threads
        self.backend, self.normaliser = rebuild(self.model), rebuild_normaliser(self.model)
        self.truth = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = not (self.model.charsmap or self.model.squeeze_spaces)
        self.by_word = self.model.words_stand_alone and self.model.dummy_prefix
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        #: Ids by word, without the word's first marker; as 32-bit ints in byte strings, which the garbage collector skips.
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differs: set[str] = set()
        spelled = [
            {UNKNOWN: " ⁇ ".encode(), CONTROL: b"", BYTE: bytes([int(p[3:5], 16)]) if kind == BYTE else b""}.get(kind, p.replace(MARK, " ").encode())
            for p, _, kind in self.model.pieces
        ]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self.normaliser.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """The marker-led words of a text, each without its first marker."""
        if self.plain and text and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in self.stretches(self.normalise(text))]

    def learn(self, words: list[str]) -> None:
        """Encode new words with the rebuilt pipeline, compare them with SentencePiece, and remember both."""
        got = [x.ids for x in self.backend.encode_batch_fast([MARK + w for w in words], add_special_tokens=False)]
        want = self.truth.encode([w.replace(MARK, " ") if MARK in w else w for w in words], num_threads=self.threads)
        if got != want:
            self.differs.update(w for w, a, b in zip(words, got, want, strict=True) if a != b)
        self.ids.update(zip(words, [array("i", x).tobytes() for x in got], strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as 32-bit ints, and whether they had to be taken from SentencePiece."""
        if not self.by_word:
            got = [x.ids for x in self.backend.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)]
            want = self.truth.encode(texts, num_threads=self.threads)
            return [array("i", w).tobytes() for w in want], [a != b for a, b in zip(got, want, strict=True)]
        if len(self.ids) > SEEN_WORDS:
            self.older, self.ids = self.ids, {}
        split = [self.words(t) for t in texts]
        new = set().union(*split) - self.ids.keys()
        if again := new & self.older.keys():
            self.ids.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self.learn(list(new))
        known = self.ids.__getitem__
        rows, repaired = [b"".join(map(known, own)) for own in split], [False] * len(texts)
        if self.differs:
            for i, (text, own) in enumerate(zip(texts, split, strict=True)):
                if not self.differs.isdisjoint(own):
                    rows[i], repaired[i] = array("i", self.truth.encode(text)).tobytes(), True
        return rows, repaired

    def decode(self, values: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id lists values[offsets[i]:offsets[i+1]], by one gather from the pieces' bytes. Lists whose
        bytes are no UTF-8 go to the backend's decoder, which marks what is broken."""
        n = len(self.lengths)
        if len(values) and (values.min() < 0 or values.max() >= n):
            raise ValueError(f"ids must be from 0 to {n - 1}")
        sizes = self.lengths[values]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.spelled[np.repeat(self.places[values] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        skip = b" " if self.model.dummy_prefix else b""
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = data[a:b].removeprefix(skip)
            try:
                out.append(own.decode())
            except UnicodeDecodeError:
                said = self.backend.decode(values[offsets[i] : offsets[i + 1]].tolist(), skip_special_tokens=False)
                out.append(said.removeprefix(skip.decode()))
        return out


@lru_cache(maxsize=2)
def codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file (half a megabyte), read once on the driver and sent along with the tasks' code; a local path, or
    one that only Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _parts(column, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow text column of about ``most`` bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes, start, held = pc.fill_null(pc.binary_length(column), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", repaired: str = "n_repaired", threads: int = 2, keep_text: bool = True) -> DataFrame:
    """``df`` with the ids of ``text`` (array of int) and whether SentencePiece's own ids had to be used (0 or 1); without
    ``keep_text`` the text itself does not come back from the tasks."""
    kept = df.select([df[c] for c in df.columns if c not in (ids, repaired)])
    schema = T.StructType([f for f in kept.schema.fields if keep_text or f.name != text] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(repaired, T.IntegerType(), False)])
    at = kept.columns.index(text)

    def run(batches):
        import pyarrow as pa

        own = codec(model, threads)
        for batch in batches:
            for a, b in _parts(batch.column(at), PART_BYTES):
                part = batch.slice(a, b - a)
                rows, odd = own.encode([x or "" for x in part.column(at).to_pylist()])
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
                flat = np.frombuffer(b"".join(rows), np.int32)
                own_columns = [c for i, c in enumerate(part.columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.array(odd, np.int32))], names=schema.names
                )

    small_batches(df.sparkSession)
    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """``df`` with the text that ``ids`` spell; null lists, and null ids within lists, spell nothing."""
    kept = df.select([df[c] for c in df.columns if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])
    at = kept.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        own = codec(model, threads)
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                lists = part.column(at)
                if lists.null_count or lists.flatten().null_count:
                    lists = pa.array([[x for x in r or [] if x is not None] for r in lists.to_pylist()], pa.list_(pa.int32()))
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                said = own.decode(values, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=schema.names)

    small_batches(df.sparkSession)
    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document: token count, a 64-bit digest of the ids, the decoded text's digest and whether it is the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = decode(encode(d, model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("same_text"),
        F.col("n_repaired").cast("long").alias("n_repaired"),
    )
