"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

Encoding finds the segmentation of the largest total log probability.  At every position the automaton's state and its
output links name all pieces that end there, and each relaxes the best score of the position.  A character without a
piece of its own is spelled in byte pieces.  A file of the Unigram type gives the log probabilities; a file of the BPE
type stores merge ranks instead, which are turned into Zipf log probabilities, so its segmentation is the Viterbi
optimum and not the merge order.  A blank is the mark U+2581 and a text starts with one; a literal U+2581 in a text is
spelled in bytes, so that decoding returns every text exactly.

Pieces hold the mark only in front (or are runs of it), so the optimum splits at words: a block's distinct words are
segmented once, all in step, byte by byte.  A long run without blanks is split further, between any two characters that
stand side by side in no piece: no piece crosses such a place, so the optimum is the same.

Null texts give null; the empty text gives no pieces.  Ids out of range and control pieces decode to nothing.  Repeated
rows are encoded alike.  Other columns are carried in ``row`` and may have any name.  The model file is a parameter,
read on the driver; it is never trained.
"""

from __future__ import annotations

import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches
from .textkit import Rolling, byte_class, runs, spans, string_buffers, text_blocks

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK, MARK_BYTE = "▁", 0xFF  # no UTF-8 text holds the byte
BLOCK_BYTES = 1 << 20
LONG_RUN = 64  # bytes from which runs are looked at character by character


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes begin, and their bytes as one number each."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(begin, append=len(data))
    code = data[begin].astype(np.uint64)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << np.uint64(8) | data[begin[more] + k]
    return begin, code


def neighbours(code: np.ndarray) -> np.ndarray:
    """One number for each two characters side by side."""
    return code[:-1] << np.uint64(32) | code[1:]


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id: their bytes (None for control pieces), log probabilities, and the ids of the 256 byte pieces."""

    pieces: tuple
    scores: tuple
    byte_ids: tuple

    @property
    def key(self) -> str:
        return f"pieces-{len(self.pieces)}-{hash((self.pieces, self.scores))}"


def load_model(path: str = MODEL_FILE) -> PieceModel:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    names, raw = [p.id_to_piece(i) for i in range(n)], np.array([p.get_score(i) for i in range(n)])
    byte_ids = [0] * 256
    pieces: list = []
    for i, name in enumerate(names):
        if p.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        pieces.append(None if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else name.replace(MARK, "\x00").encode().replace(b"\x00", bytes([MARK_BYTE])))
    normal = np.array([x is not None for x in pieces])
    if (raw[normal] == np.round(raw[normal])).all():  # ranks of merges
        weight = 1 / (1 + np.abs(raw))
        raw = np.log(weight / weight[normal].sum())
    return PieceModel(tuple(pieces), tuple(raw.tolist()), tuple(byte_ids))


class Automaton:
    """Complete goto table over bytes; per state the piece that ends there and the next shorter one (output link)."""

    def __init__(self, model: PieceModel):
        children: list[dict] = [{}]
        self.piece = [-1]
        depth = [0]
        for i, name in enumerate(model.pieces):
            if not name:
                continue
            at = 0
            for b in name:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    self.piece.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][b]
            self.piece[at] = i
        n = len(children)
        self.piece = np.array(self.piece)
        depth = np.array(depth)
        parent, byte, child = (np.array(x, np.int64) for x in zip(*[(s, b, c) for s, kids in enumerate(children) for b, c in kids.items()])) if n > 1 else (np.zeros(0, np.int64),) * 3
        self.step = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int64)
        self.link = np.zeros(n, np.int64)
        for d in range(int(depth.max()) + 1 if n > 1 else 0):  # by depth: failures are shallower
            level = np.flatnonzero(depth == d)
            if d:
                self.step[level] = self.step[fail[level]]
                self.link[level] = np.where(self.piece[fail[level]] >= 0, fail[level], self.link[fail[level]])
            own = depth[parent] == d
            p, b, c = parent[own], byte[own], child[own]
            fail[c] = self.step[p, b] if d else 0
            self.step[p, b] = c
        score = np.array(model.scores)
        self.length = np.where(self.piece >= 0, depth, 0)
        self.score = np.where(self.piece >= 0, score[self.piece], 0.0)
        normal = [s for s, x in zip(model.scores, model.pieces) if x]
        self.unknown = (min(normal) if normal else 0.0) - 10
        used = np.zeros(256, bool)
        used[byte] = True
        self.alone = ~used & byte_class((0, 0x7F))  # characters of no piece stand alone
        self.byte_ids = np.array(model.byte_ids)
        named = [x for x in model.pieces if x]
        begin, code = characters(np.frombuffer(b"".join(named), np.uint8))
        inside = ~np.isin(begin[1:], np.cumsum([len(x) for x in named]))
        self.joined = np.unique(neighbours(code)[inside]) if len(code) else code  # side by side in a piece

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units data[starts[i]:ends[i]], concatenated, and offsets; the units advance in step."""
        order = np.argsort(starts - ends, kind="stable")
        begin, length = starts[order], (ends - starts)[order]
        n, longest = len(order), int(length[0]) if len(order) else 0
        active = np.searchsorted(-length, -np.arange(longest), "left")
        base = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
        best, back = np.full(int((length + 1).sum()), -np.inf), np.zeros(int((length + 1).sum()), np.int64)
        best[base] = 0
        state, width = np.zeros(n, np.int64), np.zeros(n, np.int64)  # width: bytes so far of the current character
        for t in range(longest):
            m = active[t]
            byte = data[begin[:m] + t]
            state = self.step[state[:m], byte].astype(np.int64)
            width = np.where((byte & 0xC0) == 0x80, width[:m] + 1, 1)
            to = base[:m] + t + 1
            at = np.where(self.piece[state] >= 0, state, self.link[state])
            which = np.flatnonzero(at)
            whole = np.zeros(m, bool)  # the last character is a piece
            at = at[which]
            while len(which):
                size = self.length[at]
                value = best[to[which] - size] + self.score[at]
                better = value > best[to[which]]
                best[to[which[better]]] = value[better]
                back[to[which[better]]] = at[better]
                whole[which[size == width[which]]] = True
                at = self.link[at]
                which, at = which[at > 0], at[at > 0]
            # a character without a piece: complete when the next byte does not continue it
            final = np.ones(m, bool)
            more = np.flatnonzero(length[:m] > t + 1)
            final[more] = (data[begin[more] + t + 1] & 0xC0) != 0x80
            miss = np.flatnonzero(final & ~whole)
            value = best[to[miss] - width[miss]] + self.unknown
            better = value > best[to[miss]]
            miss, value = miss[better], value[better]
            best[to[miss]] = value
            back[to[miss]] = -width[miss]
        unit, place, choice = [], [], []
        live, pos = np.arange(n), length.copy()
        live = live[pos > 0]
        while len(live):
            got = back[base[live] + pos[live]]
            size = np.where(got < 0, -got, self.length[np.maximum(got, 0)])
            pos[live] -= size
            unit.append(live)
            place.append(pos[live])
            choice.append(got)
            live = live[pos[live] > 0]
        if not unit:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        unit, place, choice = (np.concatenate(x) for x in (unit, place, choice))
        unit_in = order[unit]
        sort = np.lexsort((place, unit_in))
        unit, place, choice, unit_in = unit[sort], place[sort], choice[sort], unit_in[sort]
        many = np.where(choice < 0, -choice, 1)
        ids = np.repeat(np.where(choice < 0, 0, self.piece[np.maximum(choice, 0)]), many)
        spelled = np.repeat(choice < 0, many)
        source = spans(begin[unit] + place, many)
        ids[spelled] = self.byte_ids[data[source[spelled]]]
        per_unit = np.bincount(unit_in, many, n).astype(np.int64)
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(per_unit)))

    def encode(self, data: np.ndarray, at: np.ndarray, hashing: Rolling) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts and their offsets."""
        size = np.diff(at)
        grown = at + np.concatenate(([0], np.cumsum(size > 0)))  # one mark before every text that is not empty
        stream = np.full(int(grown[-1]), MARK_BYTE, np.uint8)
        full = size > 0
        blanked = np.where(data == 0x20, np.uint8(MARK_BYTE), data)
        stream[spans(grown[:-1][full] + 1, size[full])] = blanked
        if not len(stream):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        mark, alone = stream == MARK_BYTE, self.alone[stream]
        cut = alone.copy()
        cut[1:] |= alone[:-1] | mark[1:] & ~mark[:-1]
        cut[grown[:-1][full]] = True
        starts = np.flatnonzero(cut)
        long = np.diff(starts, append=len(stream)) > LONG_RUN
        if long.any():
            place = spans(starts[long], np.diff(starts, append=len(stream))[long])
            begin, code = characters(stream[place])
            cut[place[begin[1:]][~np.isin(neighbours(code), self.joined)]] = True
            starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(stream))
        keys = hashing.slices(hashing.sums(stream), starts, ends)
        order = np.argsort(keys, kind="stable")
        first, many = runs(keys[order])
        one = order[first]
        ids, offsets = self.segment(stream, starts[one], ends[one])
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(first)), many)
        lengths = np.diff(offsets)[which]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return ids[spans(offsets[which], lengths)], total[np.searchsorted(starts, grown)]


def kept(key: str, make):
    """A value built once per worker process."""
    store = sys.modules.setdefault("_kinforge_kept", types.ModuleType("_kinforge_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def _carry(docs: DataFrame, *own: str) -> DataFrame:
    others = [c for c in docs.columns if c not in own]
    return docs.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []))


class Spelling:
    """Bytes of every id, for decoding."""

    def __init__(self, model: PieceModel):
        spelled = [b"" if x is None else x.replace(bytes([MARK_BYTE]), b" ") for x in model.pieces]
        for value, i in enumerate(model.byte_ids):
            spelled[i] = bytes([value]) if i else b""
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(spelled), np.uint8)

    def texts(self, ids: np.ndarray, first: np.ndarray, group: int = 256):
        """Bytes of the texts whose ids are ids[first[i]:first[i + 1]], without the mark put before them."""
        known = (ids >= 0) & (ids < len(self.lengths))
        for lo in range(0, len(first) - 1, group):  # bounded gathers
            at = first[lo : lo + group + 1]
            own = np.where(known[at[0] : at[-1]], ids[at[0] : at[-1]], 0)
            size = np.where(known[at[0] : at[-1]], self.lengths[own], 0)
            blob = self.table[spans(self.begins[own], size)].tobytes()
            ends = np.concatenate(([0], np.cumsum(size)))[at - at[0]]
            for x, y in zip(ends, ends[1:]):
                yield blob[x + 1 : y] if blob[x : min(x + 1, y)] == b" " else blob[x:y]


def encode(docs: DataFrame, model: PieceModel, check: bool = False) -> DataFrame:
    """text, [row,] ids of every row of ``docs``; with ``check`` also round_trip: whether the ids decode to the text."""
    frame = _carry(docs, "text")
    names, key = frame.columns, model.key
    packed = model.pieces, model.scores, model.byte_ids

    def kernel(batch: pa.RecordBatch):
        automaton = kept(key, lambda: Automaton(PieceModel(*packed)))
        spelling = kept(f"{key}-spelling", lambda: Spelling(PieceModel(*packed))) if check else None
        hashing = Rolling(7)
        text = batch.column(0)
        for lo, hi, data, at in text_blocks(text, BLOCK_BYTES):
            ids, offsets = automaton.encode(data, at, hashing)
            gone = text.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
            # from_arrays reads a null offset as a null list
            out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(gone, False)), pa.array(ids))]
            if check:
                out.append(pa.array([got == data[a:b].tobytes() for got, a, b in zip(spelling.texts(ids, offsets), at, at[1:])], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(names))] + out, names=names + ["ids", "round_trip"][: len(out)])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("round_trip", T.BooleanType())] if check else [])
    return map_batches(frame, kernel, T.StructType([*frame.schema.fields, *more]))


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """ids, [row,] decoded of every row."""
    frame = _carry(encoded, "ids")
    names, key = frame.columns, model.key
    packed = model.pieces, model.scores, model.byte_ids

    def kernel(batch: pa.RecordBatch):
        spelling = kept(f"{key}-spelling", lambda: Spelling(PieceModel(*packed)))
        lists = batch.column(0)
        gone = lists.is_null().to_numpy(zero_copy_only=False)
        counts = np.where(gone, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = [None if no else got.decode("utf-8", "replace") for no, got in zip(gone, spelling.texts(ids, np.concatenate(([0], np.cumsum(counts)))))]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(out, pa.string())], names=names + ["decoded"])

    return map_batches(frame, kernel, T.StructType([*frame.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_in_memory(text: str | None, model: PieceModel) -> list[int] | None:
    """Brute-force Viterbi over all substrings of one text.  For tests."""
    if text is None:
        return None
    if not text:
        return []
    score = {x: (s, i) for i, (x, s) in enumerate(zip(model.pieces, model.scores)) if x}
    unknown = min(s for s, _ in score.values()) - 10
    chars = [bytes([MARK_BYTE])] + [bytes([MARK_BYTE]) if c == " " else c.encode() for c in text]
    best: list = [(0.0, [])] + [None] * len(chars)
    for j in range(1, len(chars) + 1):
        options = []
        for i in range(max(0, j - 64), j):
            piece = b"".join(chars[i:j])
            if piece in score:
                options.append((best[i][0] + score[piece][0], best[i][1] + [score[piece][1]]))
            elif j == i + 1:
                options.append((best[i][0] + unknown, best[i][1] + [model.byte_ids[b] for b in piece]))
        best[j] = max(options, key=lambda x: x[0])
    return best[-1][1]
