"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Encoding: a text is cut into units, a run of non-space characters with the one space before it, or a run of spaces.  The
pieces of a SentencePiece model that fit into a unit form its lattice, with the UTF-8 byte pieces for characters without
a piece.  Forward filtering sums the weights of all paths to each place; backward sampling draws the last piece in
proportion to the paths that end with it, and so on to the start.  A piece of rank r (its place in the model) weighs
(r + 1) ** -alpha, a byte piece BYTE_PENALTY less in the logarithm.  The draws come from a counter-based generator keyed
by the row key, the unit and the step, and are compared with whole 32-bit thresholds, so that a row gives the same pieces
in every batch, partition and run.

The lattice of a distinct unit is computed once per batch, for all units together, in numpy; so are the draws.

Decoding joins the pieces: the model's space mark is a space, byte pieces are bytes.  A space mark in the text itself is
encoded by its bytes.  decode(encode(text)) is the text for every string.

The path of the model is a parameter; it is read on the driver and its bytes are sent along with the tasks (0.5 MB).

Cases: null texts encode as null and decode as null, empty ones as no pieces; units longer than UNIT_MAX characters are
cut there, which only keeps pieces from spanning the cut; rows of equal key and text give equal pieces; a null key is a
key like any other; an empty table gives no rows; other columns are carried along unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches

MARK = "▁"
UNIT = re.compile(r" ?[^ ]+| +(?= )| ")
UNIT_MAX = 128
ALPHA = 1.0
BYTE_PENALTY = 10.0
SEED = 0
DEFAULT_MODEL = "piece_bpe_32k.model"
BLEND = 0x9E3779B97F4A7C15
M = np.uint64


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces of a model by length, as rows of code points, with log weights."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of: list[bytes] = []
        ids, self.byte_ids = {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                self.byte_ids[self.bytes_of[-1][0]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                ids.setdefault(piece.replace(MARK, " "), i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        self.log_weight = -alpha * np.log(np.arange(1, len(self.bytes_of) + 1, dtype=float))
        self.byte_weight = float(self.log_weight.min() - BYTE_PENALTY)
        self.by_length = {}
        for n in sorted({len(p) for p in ids}):
            rows = [(p, i) for p, i in ids.items() if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p, _ in rows], np.uint32)
            order = np.argsort(keys := rolled(codes), kind="stable")
            some = np.zeros(1 << 16, bool)
            some[(keys * M(BLEND)) >> M(48)] = True
            self.by_length[n] = keys[order], codes[order], np.array([i for _, i in rows], np.int64)[order], some


def rolled(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of code points."""
    h = np.zeros(len(codes), M)
    for j in range(codes.shape[1]):
        h = h * M(0x100000001B3) + codes[:, j].astype(M) + M(1)
    return h


class Lattices:
    """Sampling tables of a list of distinct units.

    Node k stands for a place in a unit; its arcs are the pieces that end there.  `keys` holds node << 32 | threshold,
    sorted, so that one search finds the arc of a draw.
    """

    def __init__(self, units: list[str], voc: Vocabulary):
        lengths = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.r_[0, np.cumsum(lengths + 1)]  # one node more than characters per unit
        char_node = np.arange(len(codes)) + np.repeat(np.arange(len(units)), lengths)  # node before each character
        unit_end = np.repeat(base[1:] - 1, lengths)  # last node of the unit of each character
        starts, ends, pieces, weights = [], [], [], []
        wide_codes = codes.astype(M) + M(1)
        covered = np.zeros(len(codes), bool)
        room = unit_end - char_node  # characters from here to the end of the unit
        here, h = np.arange(len(codes)), np.zeros(len(codes), M)
        for n in range(1, max(voc.by_length) + 1):
            if n > 1:
                enough = room[here] >= n
                here, h = here[enough], h[enough]
            h = h * M(0x100000001B3) + wide_codes[here + (n - 1)]
            if not len(here):
                break
            if n not in voc.by_length:
                continue
            keys, rows, ids, some = voc.by_length[n]
            near = np.flatnonzero(some[(h * M(BLEND)) >> M(48)])  # most places have no piece of this length
            place = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
            hit = keys[place] == h[near]
            at, place = here[near[hit]], place[hit]
            # The key only proposes; the characters decide.
            same = (codes[at[:, None] + np.arange(n)] == rows[place]).all(axis=1)
            at, place = at[same], place[same]
            if n == 1:
                covered[at] = True
            starts.append(char_node[at])
            ends.append(char_node[at] + n)
            pieces.append(ids[place])
            weights.append(voc.log_weight[ids[place]])
        # A character without a piece of its own: its UTF-8 bytes, one arc that stands for all of them (piece -1 - code).
        at = np.flatnonzero(~covered)
        wide = 1 + (codes[at] > 0x7F).astype(int) + (codes[at] > 0x7FF) + (codes[at] > 0xFFFF)
        starts.append(char_node[at])
        ends.append(char_node[at] + 1)
        pieces.append(-1 - codes[at].astype(np.int64))
        weights.append(voc.byte_weight * wide)
        # Long pieces first: a stable sort by end then has the starts of a node in their order.
        start, end = np.concatenate(starts[::-1]), np.concatenate(ends[::-1])
        piece, weight = np.concatenate(pieces[::-1]), np.concatenate(weights[::-1])
        order = np.argsort(end, kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        # Forward filtering, all units at once, place by place.
        total = np.full(int(base[-1]), -np.inf)
        total[base[:-1]] = 0.0
        unit_of = np.repeat(np.arange(len(units)), lengths + 1)
        depth = end - base[unit_of[end]]
        depth = depth.astype(np.min_scalar_type(int(depth.max()) + 2 if len(depth) else 1))
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        for a, b in zip(edges[:-1], edges[1:]):
            arcs = by_depth[a:b]
            if len(arcs):
                e = end[arcs]
                cut = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                total[e[cut]] = np.logaddexp.reduceat(total[start[arcs]] + weight[arcs], cut)
        share = np.exp(total[start] + weight - total[end])
        # Thresholds: shares added up arc by arc within a node, so that they do not depend on what else is in the batch.
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(end)])
        upto = np.zeros(len(end))
        run = np.zeros(len(first))
        for r in range(int(count.max()) if len(count) else 0):
            has = count > r
            run[has] += share[first[has] + r]
            upto[first[has] + r] = run[has]
        limit = np.minimum(np.floor(upto * 2.0**32), 2.0**32 - 1).astype(M)
        if len(first):
            limit[first + count - 1] = M(2**32 - 1)
        self.keys = (end.astype(M) << M(32)) | limit
        self.start, self.piece = start, piece
        self.unit_start, self.unit_end = base[:-1], base[1:] - 1

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in their order, and how many each has.  unit: which; key: 64 bits per occurrence."""
        node, stop = self.unit_end[unit], self.unit_start[unit]
        live = np.argsort(unit.astype(np.int32), kind="stable")  # neighbours search neighbouring nodes
        steps = []
        count = np.zeros(len(unit), np.int64)
        step = 0
        while len(live):
            draw = mixed(key[live] + M((step * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> M(32)
            arc = np.searchsorted(self.keys, (node[live].astype(M) << M(32)) | np.minimum(draw, M(2**32 - 2)), side="right")
            steps.append((live, self.piece[arc]))
            count[live] += 1
            node[live] = self.start[arc]
            live = live[node[live] != stop[live]]
            step += 1
        out = np.empty(int(count.sum()), np.int64)
        last = np.cumsum(count) - 1
        for s, (who, piece) in enumerate(steps):
            out[last[who] - s] = piece
        return out, count


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> M(30))) * M(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> M(27))) * M(0x94D049BB133111EB)
    return h ^ (h >> M(31))


def units_of(text: str) -> list[str]:
    out = UNIT.findall(text)
    if max(map(len, out), default=0) > UNIT_MAX:
        out = [u[i : i + UNIT_MAX] for u in out for i in range(0, len(u), UNIT_MAX)]
    return out


def encode_batch(texts: list[str | None], keys: list, voc: Vocabulary, seed: int = SEED) -> list[np.ndarray | None]:
    """Piece ids of each text."""
    flat, lengths = encode_flat(texts, keys, voc, seed)
    ends = np.cumsum(lengths)
    return [None if t is None else flat[e - n : e] for t, e, n in zip(texts, ends, lengths)]


def encode_flat(texts: list[str | None], keys: list, voc: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and how many each has."""
    every, sizes, at = [], [], []
    for text, key in zip(texts, keys):
        units = units_of(text) if text else []
        every += units
        sizes.append(len(units))
        row = M(xxhash.xxh64_intdigest(f"{seed}:{key}"))
        at.append(mixed(row + np.arange(len(units), dtype=M) * M(0xD1342543DE82EF95)))
    if not every:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    unit, distinct = pd.factorize(np.array(every, dtype=object))
    pieces, count = Lattices(distinct.tolist(), voc).sample(unit, np.concatenate(at))
    if (pieces < 0).any():  # characters without a piece become their bytes
        reps = np.ones(len(pieces), np.int64)
        odd = np.flatnonzero(pieces < 0)
        raw = [chr(-1 - int(p)).encode("utf-8", "surrogatepass") for p in pieces[odd]]
        reps[odd] = [len(r) for r in raw]
        place = np.cumsum(reps) - reps
        wide = np.repeat(pieces, reps)
        for p, r in zip(place[odd], raw):
            wide[p : p + len(r)] = [voc.byte_ids[x] for x in r]
        pieces, count = wide, np.add.reduceat(reps, np.cumsum(count) - count)
    per_text = np.add.reduceat(np.r_[count, 0], np.minimum(np.cumsum(sizes) - sizes, len(count))) * (np.array(sizes) > 0)
    return pieces.astype(np.int32), per_text


def decode_ids(ids: list[int] | None, voc_bytes: list[bytes]) -> str | None:
    return None if ids is None else b"".join(map(voc_bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")


_VOCABULARIES: dict = {}  # of this worker, by model and alpha


def _vocabulary(model: bytes, alpha: float) -> Vocabulary:
    at = (xxhash.xxh64_intdigest(model), alpha)
    if at not in _VOCABULARIES:
        _VOCABULARIES[at] = Vocabulary(model, alpha)
    return _VOCABULARIES[at]


def _model(path: str | None) -> bytes:
    with open(path or model_path(), "rb") as f:
        return f.read()


def _encode_arrow(texts: list[str | None], keys: list, voc: Vocabulary, seed: int, slab: int) -> pa.ListArray:
    flat, lengths, a, size = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= slab or i + 1 == len(texts):
            ids, n = encode_flat(texts[a : i + 1], keys[a : i + 1], voc, seed)
            flat.append(ids)
            lengths.append(n)
            a, size = i + 1, 0
    offsets = pa.array(np.cumsum(np.concatenate(lengths)), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))


def _decode_arrow(lists: pa.ListArray, voc: Vocabulary) -> list[str | None]:
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    return [decode_ids(flat[a:b].tolist(), voc.bytes_of) if ok else None for a, b, ok in zip(at, at[1:], lists.is_valid().to_pylist())]


def encoded(text: Column, key: Column, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, slab: int = 1 << 19) -> Column:
    """Piece ids of `text`, an array of int; batches are worked on in slabs of about `slab` characters."""
    model = _model(path)
    small_batches(SparkSession.active())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        voc = _vocabulary(model, alpha)
        for texts, keys in parts:
            yield _encode_arrow(texts.to_pylist(), keys.to_pylist(), voc, seed, slab)

    return encode(text, key.cast("string"))


CHECKED = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])


def encoded_and_checked(
    text: Column, key: Column, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, slab: int = 1 << 19,
) -> Column:
    """Piece ids of `text` and whether they decode to it, in one pass and one Python worker per task."""
    model = _model(path)
    small_batches(SparkSession.active())

    @F.arrow_udf(CHECKED)
    def both(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        voc = _vocabulary(model, alpha)
        for texts, keys in parts:
            texts = texts.to_pylist()
            ids = _encode_arrow(texts, keys.to_pylist(), voc, seed, slab)
            same = pa.array([a == b for a, b in zip(_decode_arrow(ids, voc), texts)], pa.bool_())
            yield pa.StructArray.from_arrays([ids, same], names=["piece_ids", "lossless"])

    return both(text, key.cast("string"))


def decoded(ids: Column, path: str | None = None) -> Column:
    model = _model(path)
    small_batches(SparkSession.active())

    @F.arrow_udf(T.StringType())
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc = _vocabulary(model, ALPHA)
        for lists in parts:
            yield pa.array(_decode_arrow(lists, voc), pa.string())

    return decode(ids)


def encode(docs: DataFrame, key: str = "doc_id", path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with `piece_ids`, sampled by `key`."""
    return docs.withColumn("piece_ids", encoded(F.col("text"), F.col(key), path, alpha, seed))


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with `decoded`, the text of `piece_ids`."""
    return docs.withColumn("decoded", decoded(F.col("piece_ids"), path))
