"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a vocabulary drives a single-pass Viterbi: at each position the output
links give all pieces that end there, and each relaxes the best score of the position. Characters that no piece covers
are spelled in byte pieces. Decoding is exact: blanks become the piece mark, a mark of the text itself is spelled in
bytes, and the blank put before the text is taken away again.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, prepare, tidy

MARK = "▁"
#: The default vocabulary, among the public files of the box; a parameter of every entry point.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units (a run of marks and the characters after it) a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: A score below that of every piece, for each character that is spelled in bytes.
PENALTY = 10.0
UNIT = re.compile(f"{MARK}*[^{MARK}]*")


def read_model(path: str = MODEL) -> dict:
    """Pieces, scores and byte pieces of a SentencePiece model file, as plain data."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    usable = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {
        "pieces": [(i, sp.id_to_piece(i), sp.get_score(i)) for i in usable],
        "bytes": {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)},
        "unknown": sp.unk_id(),
        "size": sp.vocab_size(),
    }


class Codec:
    """Encoder and decoder of one vocabulary.

    model: pieces (id, text, score), bytes {value: id}, unknown id. Without all byte pieces a character that no piece
    covers becomes the unknown id, which decodes to U+2047.
    """

    def __init__(self, model: dict):
        self.automaton = ahocorasick.Automaton()
        self.texts: dict[int, bytes] = {}
        worst = 0.0
        for i, piece, score in model["pieces"]:
            self.automaton.add_word(piece, (len(piece), score, i))
            self.texts[i] = piece.replace(MARK, " ").encode("utf-8", "surrogatepass")
            worst = min(worst, score)
        self.automaton.make_automaton()
        self.bytes, self.unknown = model["bytes"], model["unknown"]
        self.spelled = len(self.bytes) == 256
        self.texts |= {i: bytes([v]) for v, i in self.bytes.items()} | {self.unknown: "⁇".encode()}
        self.worst = worst - PENALTY
        # Where no piece goes on over a mark, units can be encoded apart, and remembered.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for _, p, _ in model["pieces"])
        self.known: dict[str, list[int]] = {}

    def _spell(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.spelled else [self.unknown]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation of greatest score. Ties: the longer last piece, then the lower id."""
        n, worst = len(text), self.worst
        best, back = [0.0] * (n + 1), [(1, -1)] * (n + 1)
        done = 0  # positions up to here have been reached; those before are final
        for last, (length, score, i) in self.automaton.iter(text):  # output links give all pieces that end at a position
            end = last + 1
            while done < end:
                done += 1
                best[done] = best[done - 1] + worst
            s = best[end - length] + score
            if s > best[end] or (s == best[end] and (length, -i) > (back[end][0], -back[end][1])):
                best[end], back[end] = s, (length, i)
        out, end = [], n
        while end:
            length, i = back[end]
            out.append([i] if i >= 0 else self._spell(text[end - 1]))
            end -= length
        return [i for part in reversed(out) for i in part]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; null and empty texts give none."""
        if not text:
            return []
        out: list[int] = []
        # A mark in the text itself is no blank: it is spelled, between the encodings of what surrounds it.
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += self._spell(MARK)
            part = part.replace(" ", MARK) if k else MARK + part.replace(" ", MARK)
            if not self.apart:
                out += self.viterbi(part)
                continue
            units = UNIT.findall(part)
            try:
                for u in units:
                    out += self.known[u]
            except KeyError:
                at = units.index(u)
                for u in units[at:]:
                    ids = self.known.get(u)
                    if ids is None:
                        if len(self.known) > REMEMBERED:
                            self.known.clear()
                        ids = self.viterbi(u)
                        if len(u) <= 64:
                            self.known[u] = ids
                    out += ids
        return out

    def decode(self, ids) -> str:
        data = b"".join([self.texts.get(i, b"") for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass" if b"\xed" in data else "replace")


def encode_documents(docs: DataFrame, keep: list, text_col: str = "text", model: dict | str = MODEL, digests: bool = False) -> DataFrame:
    """The columns `keep` of each row with ids (array of int) or, with digests, n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit numbers), decoded_sha256 (of the decoded text) and exact (whether it is the text).

    Null counts as the empty text: no ids. Texts are read whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    shared = spark.sparkContext.broadcast(read_model(model) if isinstance(model, str) else model)
    key = uuid.uuid4().hex
    extra = ["n_tokens", "ids_sha256", "decoded_sha256", "exact"] if digests else ["ids"]

    def run(batches):
        codec = kept_in_worker(key, lambda: Codec(shared.value))
        for b in batches:
            out: list[list] = [[] for _ in extra]
            for text in b.column("_text").to_pylist():
                ids = codec.encode(text)
                if digests:
                    back = codec.decode(ids)
                    row = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or ""))
                else:
                    row = (np.array(ids, np.int32),)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()] if digests else [pa.list_(pa.int32())]
            yield pa.record_batch([*(b.column(n) for n in names), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*names, *extra])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), fields + ("n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" if digests else "ids array<int>"))


def decode_documents(encoded: DataFrame, keep: list, ids_col: str = "ids", model: dict | str = MODEL) -> DataFrame:
    """The columns `keep` of each row with text, decoded from its ids. Null ids give the empty text; ids that the
    vocabulary lacks give nothing."""
    spark = encoded.sparkSession
    prepare(spark)
    rows = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    names = rows.columns[:-1]
    shared = spark.sparkContext.broadcast(read_model(model) if isinstance(model, str) else model)
    key = uuid.uuid4().hex

    def run(batches):
        codec = kept_in_worker(key, lambda: Codec(shared.value))
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column("_ids").to_pylist()]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), fields + "text string")
