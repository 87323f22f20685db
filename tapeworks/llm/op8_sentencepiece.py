"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

The model is byte-pair encoding: the encoding of a text is its only segmentation whose neighbouring tokens are
compatible, that is, encode to themselves when joined. Give compatible neighbours weight 0 and others minus
infinity, and the encoding is the one path of finite weight, so a best-path scan over (position, last token) finds
exactly the tokens of the merge procedure, left to right.

* Ordinary documents are cut where no token can cross (before a run of spaces, around line breaks). Units are encoded once
  and remembered; a unit of over ``LONG_UNIT`` characters is encoded by the scan.
* Giant documents are split into chunks anywhere. For each chunk a task computes the transfer matrix: from every boundary
  state in which a token may cross its start to those reachable at its end. Matrices are combined along a
  document in the max-plus semiring, the one finite path fixes each chunk's states, and each chunk is encoded on its
  own: the units at both ends are traced back from the scan, the library encodes those between the safe cuts.

Spaces become ``MARK`` and one is put in front of a text that is not empty; characters without a piece become
byte tokens. Decoding undoes both, so every text comes back exactly unless it contains ``MARK`` itself, which
decodes as a space; ``round_trip`` says so. Null and empty texts have no tokens. Rows are kept one to one.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.shared import table
from tapeworks.llm.words import batch_of, slices
from tapeworks.session import staged

MARK = "▁"
MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
LONG_UNIT = 200
#: Units that a task remembers; all are forgotten when there are more.
MOST_UNITS = 150_000

#: A boundary state: characters of the crossing token beyond the boundary, and that token.
State = tuple[int, str]


class Pieces:
    """The vocabulary, the merge procedure on short texts, and the scan on long ones."""

    def __init__(self, model_bytes: bytes) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in piece.lstrip(MARK) or "\n" in piece[1:] + piece[:-1] for piece in self.ids):
            raise ValueError("the model has pieces across words or lines; texts can't be cut there")
        self.fits: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}

    #: Parts that no token crosses: a run of spaces with the word after it, or a line break.
    UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def merge(self, text: str) -> list[str]:
        """The merge procedure: join the neighbours with the best score, the leftmost of equals, until none is left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are when their texts are joined; "" is the start of a text."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 20 * MOST_UNITS:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def scan(self, text: str, start: int, token: str, stop: int) -> dict[int, str]:
        """Last tokens by end position of all paths on from ``token``, which ends at ``start``; tokens begin before
        ``stop``. There is one path to each position at most."""
        last, ids, fits = {start: token}, self.ids, self.fits
        for end in range(start + 1, min(len(text), stop + self.longest - 1) + 1):
            for begin in range(max(start, end - self.longest), min(end, stop)):
                before = last.get(begin)
                if before is None:
                    continue
                piece = text[begin:end]
                if end - begin > 1 and piece not in ids:
                    continue
                fit = fits.get((before, piece))
                if fit if fit is not None else self.compatible(before, piece):
                    last[end] = piece
                    break
        return last

    def trace(self, last: dict[int, str], start: int, end: int) -> list[str]:
        """Tokens of the path from ``start`` to ``end``."""
        tokens = []
        while end > start:
            tokens.append(last[end])
            end -= len(last[end])
        return tokens[::-1]

    def packed(self, tokens: list[str]) -> bytes:
        ids = []
        for token in tokens:
            known = self.ids.get(token)
            ids += [known] if known is not None else [self.byte_ids[b] for b in token.encode("utf-8")]
        return np.array(ids, "<i4").tobytes()

    def learn(self, units: set[str]) -> None:
        """Encode units that are not remembered yet, many at once by the library, which merges alike.

        It puts a space in front by itself; a unit without one is shown behind a line break instead.
        """
        if len(self.units) > MOST_UNITS:
            self.units.clear()
        long = [u for u in units if len(u) > LONG_UNIT]
        short = [u for u in units if len(u) <= LONG_UNIT and u != MARK]
        shown = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u for u in short]
        for unit, ids in zip(short, self.model.encode(shown, num_threads=1) if shown else [], strict=True):
            self.units[unit] = array("i", ids if unit[0] == MARK else ids[2:]).tobytes()
        if MARK in units:  # the library takes it for an empty text
            self.units[MARK] = self.packed([MARK])
        for unit in long:
            self.units[unit] = self.packed(self.trace(self.scan(unit, 0, "", len(unit)), 0, len(unit)))

    def encode_many(self, marked: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of texts whose spaces are marked."""
        units = [self.UNIT.findall(text) for text in marked]
        new = set().union(*units).difference(self.units)
        if new:
            self.learn(new | set().union(*units) if len(self.units) > MOST_UNITS else new)
        known = self.units.__getitem__
        return [b"".join(map(known, own)) for own in units]

    def encode(self, marked: str) -> bytes:
        return self.encode_many([marked])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids, with all spaces, the one in front included."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")

    # --- chunks of giant documents: text[start:stop], with context on both sides

    def entries(self, text: str, start: int) -> list[State]:
        """All boundary states in which a token may cross ``start`` or end there."""
        found = []
        for begin in range(max(0, start - self.longest), start):
            for end in range(start, min(len(text), begin + self.longest) + 1):
                piece = text[begin:end]
                if len(piece) == 1 or piece in self.ids and self.compatible("", piece):
                    found.append((end - start, piece))
        return found

    def cuts(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last place inside that no token crosses."""
        places = [m.start() for m in self.UNIT.finditer(text, start, stop)]
        # the first unit begins where the chunk was cut, which is a safe place only by chance
        places = [p for p in places if p > start and (text[p] == "\n" or text[p - 1] == "\n" or text[p - 1] != MARK)]
        return (places[0], places[-1]) if places else None

    def exits(self, text: str, start: int, token: str, stop: int) -> list[State]:
        last = self.scan(text, start, token, stop)
        return [(end - stop, piece) for end, piece in last.items() if end >= stop > end - len(piece) or end == start == stop]

    def transfer(self, text: str, start: int, stop: int, first: bool) -> list[tuple[State, State]]:
        """Pairs of boundary states at both ends of a chunk that a path joins; all others have minus infinity."""
        states = [(0, "")] if first else self.entries(text, start)
        cut = self.cuts(text, start, stop)
        if cut:
            out = self.exits(text, cut[1], "", stop)
            inside = [s for s in states if start + s[0] <= cut[0] and self._reaches(text, start + s[0], s[1], cut[0])]
            return [(s, e) for s in inside for e in out]
        pairs = []
        for offset, token in states:
            if start + offset < stop:
                pairs += [((offset, token), e) for e in self.exits(text, start + offset, token, stop)]
            else:  # one token covers the rest of the chunk
                pairs.append(((offset, token), (start + offset - stop, token)))
        return pairs

    def _reaches(self, text: str, at: int, token: str, place: int) -> bool:
        return at == place or place in self.scan(text[:place], at, token, place)

    def between(self, text: str, start: int, stop: int, enter: State, leave: State) -> bytes:
        """Ids of the tokens after ``enter`` up to and with ``leave``."""
        at, end = start + enter[0], stop + leave[0]
        cut = self.cuts(text, start, stop)
        if not cut:
            return self.packed(self.trace(self.scan(text, at, enter[1], stop), at, end)) if at < end else b""
        head = self.trace(self.scan(text[: cut[0]], at, enter[1], cut[0]), at, cut[0])
        tail = self.trace(self.scan(text, cut[1], "", stop), cut[1], end)
        return self.packed(head) + self.encode(text[cut[0] : cut[1]]) + self.packed(tail)


@lru_cache(maxsize=2)
def _pieces(model_bytes: bytes) -> Pieces:
    return Pieces(model_bytes)


def combined(matrices: list[list[tuple[State, State]]]) -> list[tuple[State, State]]:
    """States at both ends of each chunk on the one finite path through all matrices."""
    reached = [{(0, "")}]
    for matrix in matrices:
        reached.append({leave for enter, leave in matrix if enter in reached[-1]})
    path, state = [], next(s for s in reached[-1] if s[0] == 0)
    for matrix, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        enter = next(e for e, leave in matrix if leave == state and e in before)
        path.append((enter, state))
        state = enter
    return path[::-1]


def _marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _encode_rows(docs: DataFrame, keep: list[str], text: str, model: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for part in slices(batch, text):
                offsets, data, same = [0], [], []
                raws = part.column(text).to_pylist()
                for raw, ids in zip(raws, pieces.encode_many([_marked(raw or "") for raw in raws]), strict=True):
                    data.append(ids)
                    offsets.append(offsets[-1] + len(ids) // 4)
                    same.append((pieces.decode(ids)[1:] if ids else "") == (raw or ""))
                values = np.frombuffer(b"".join(data), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                columns = [part.column(c) for c in keep] + [ids, pa.array(same)]
                yield batch_of(columns, schema)

    out = _encoded_schema(docs, keep)
    schema = to_arrow_schema(out)
    return docs.select(*[F.col(f"`{c}`") for c in [*keep, *([] if text in keep else [text])]]).mapInArrow(run, out)


def _encoded_schema(docs: DataFrame, keep: list[str]):
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    return StructType([
        *[docs.schema[c] for c in keep], StructField("token_ids", ArrayType(IntegerType())),
        StructField("round_trip", BooleanType()),
    ])


def _encode_giants(docs: DataFrame, keep: list[str], text: str, model: bytes, longest: int, chunk: int) -> DataFrame:
    """Documents of several chunks: transfer matrices, their product along each document, and one trace per chunk."""
    giants = docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*keep).alias("_kept"), F.col(text).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                marked = _marked(raw)
                for c, start in enumerate(range(0, len(marked), chunk)):
                    stop = min(len(marked), start + chunk)
                    low = max(0, start - longest)
                    kept = batch.column(1).slice(i, 1) if c == 0 else pa.nulls(1, batch.column(1).type)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key]), pa.array([c], pa.int32()), pa.array([marked[low : stop + longest]]),
                        pa.array([start - low], pa.int32()), pa.array([stop - low], pa.int32()),
                        pa.array([MARK not in raw]), kept,
                    ], names=["key", "chunk", "text", "start", "stop", "clean", "kept"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for row in batch.to_pylist():
                pairs = pieces.transfer(row["text"], row["start"], row["stop"], row["chunk"] == 0)
                yield pa.RecordBatch.from_pylist([{
                    "key": row["key"], "chunk": row["chunk"],
                    "pairs": [{"a": a, "s": s, "b": b, "t": t} for (a, s), (b, t) in pairs],
                }], schema=pair_schema)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrices = [[((p["a"], p["s"]), (p["b"], p["t"])) for p in m["pairs"]] for m in row["matrices"]]
                path = combined(matrices)
                yield pa.RecordBatch.from_pylist([
                    {"key": row["key"], "chunk": c, "a": enter[0], "s": enter[1], "b": leave[0], "t": leave[1]}
                    for c, (enter, leave) in enumerate(path)
                ], schema=path_schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for row in batch.to_pylist():
                ids = pieces.between(row["text"], row["start"], row["stop"], (row["a"], row["s"]), (row["b"], row["t"]))
                own = row["text"][row["start"] + row["a"] : row["stop"] + row["b"]].replace(MARK, " ")
                yield pa.RecordBatch.from_pylist([{
                    "key": row["key"], "chunk": row["chunk"], "ids": np.frombuffer(ids, "<i4").tolist(),
                    "same": row["clean"] and pieces.decode(ids) == own,
                }], schema=id_schema)

    spark = docs.sparkSession
    kept_type = giants.schema["_kept"].dataType.simpleString()
    chunk_type = f"key long, chunk int, text string, start int, stop int, clean boolean, kept {kept_type}"
    pair_type = "key long, chunk int, pairs array<struct<a: int, s: string, b: int, t: string>>"
    path_type, id_type = "key long, chunk int, a int, s string, b int, t string", "key long, chunk int, ids array<int>, same boolean"
    pair_schema, path_schema, id_schema = (
        to_arrow_schema(spark.createDataFrame([], t).schema) for t in (pair_type, path_type, id_type)
    )
    chunks = staged(giants.mapInArrow(split, chunk_type).repartition("key", "chunk"), "giant-chunks")
    matrices = chunks.drop("kept").mapInArrow(matrix, pair_type)
    paths = matrices.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "pairs"))).alias("matrices"))
    paths = paths.mapInArrow(product, path_type)
    traced = chunks.drop("kept").join(paths, ["key", "chunk"]).mapInArrow(trace, id_type)
    done = traced.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"), F.every("same").alias("round_trip")
    )
    rows = done.join(chunks.where("chunk = 0").select("key", "kept"), "key")
    return rows.select(
        *[F.col(f"kept.`{c}`").alias(c) for c in keep], F.flatten(F.col("parts.ids")).alias("token_ids"), "round_trip"
    )


def encode_texts(
    docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL, giant: int = 50_000, chunk: int = 16_000
) -> DataFrame:
    """The columns ``keep`` with ``token_ids`` and ``round_trip`` (whether the ids decode to the text)."""
    with open(model, "rb") as file:
        data = file.read()
    longest = _pieces(data).longest
    body = F.coalesce(F.col(text), F.lit(""))
    ordinary = _encode_rows(docs.where(F.length(body) <= giant), keep, text, data)
    giants = _encode_giants(docs.where(F.length(body) > giant), keep, text, data, longest, chunk)
    return ordinary.unionByName(giants)


def decode_ids(tokens: DataFrame, ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``tokens`` with the ``decoded`` text of the ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    with open(model, "rb") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(data)
        for batch in batches:
            texts = [
                pieces.decode(np.array(row or [], "<i4").tobytes())[1:] for row in batch.column(ids).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, schema.field("decoded").type)], schema=schema)

    out = StructType([*tokens.schema.fields, StructField("decoded", StringType())])
    schema = to_arrow_schema(out)
    return tokens.mapInArrow(run, out)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return tokens.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), "round_trip",
    )
