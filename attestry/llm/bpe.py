"""Byte-level BPE through a sentencepiece model that is written from the rank file, not trained.

Each byte is mapped to one character (U+0100 + byte), so every vocabulary entry is a string; its score is the
negative rank, so sentencepiece merges the pair of lowest rank first, leftmost first, as the rank file means it.
Normalisation is the identity. Pre-tokens are encoded one by one; ids are ranks. Decoding joins the byte strings
of the ids.

Null texts count as empty and give no ids; repeated rows are encoded each on its own; an empty table gives an empty
result; columns other than the two named are not read."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.batches import slices, strings
from attestry.llm.pieces import Encoder

_TO_CHARS = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def as_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece BPE model whose piece ids are the ranks 0..n-1; id n is the unused unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    model = pb.ModelProto()
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=as_chars(raw), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(ranks), -1, -1, -1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self._ranks = ranks
        self._bytes = [raw for raw, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self._split = regex.compile(pattern).findall
        self._model = SentencePieceProcessor(model_proto=model_bytes(ranks))
        self._texts = Encoder(self._encode_batch)

    def _encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [[x.encode() for x in self._split(t)] for t in texts]
        # A pre-token that is an entry is that entry, even where no chain of merges builds it.
        rest = list({x for c in cut for x in c if x not in self._ranks})
        known = dict(zip(rest, self._model.encode([as_chars(x) for x in rest], out_type=int, num_threads=1), strict=True)) if rest else {}
        out = []
        for c in cut:
            ids: list[int] = []
            for x in c:
                rank = self._ranks.get(x)
                ids.append(rank) if rank is not None else ids.extend(known[x])
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._texts(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each text as a binary column of little-endian unsigned 32-bit integers, and the decoded bytes.

    ``ranks_path`` must name the same file on every executor (a file of an installed package)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for part in slices(batches, text):
            ids = bpe.encode(strings(part.column(text)))
            yield pa.RecordBatch.from_arrays(
                [part.column(ident), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
                 pa.array([bpe.decode(x) for x in ids], pa.binary())],
                names=[ident, "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and the SHA-256 digests of the ids and of the decoded bytes of each text."""
    from pyspark.sql import functions as F

    coded = encode_documents(docs, ranks_path, pattern, ident, text)
    return coded.select(ident, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
