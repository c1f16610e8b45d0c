"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a block, in order, are one stream of token ids. Windows cut the stream at document
ends, at sentence ends and, where neither is near, at fixed steps. With candidate positions c and
cost f of the best packing up to each,

    f[j] = penalty(j) + PER_WINDOW + min over i, c[j] - c[i] <= width, of f[i] + padding(c[j] - c[i]).

The padding, width - c[j] + c[i], splits into a part of i and a part of j, so the minimum is that of
f[i] + c[i] over a sliding window, kept in a monotone queue: one step for each candidate. What is
left in the last window of a block goes to windows of a power of two, which need no padding.

Blocks are packed where they are read: no shuffle, and memory for one block.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import narrow_batches

#: Costs in tokens of padding: of a window, of a cut inside a document at a sentence end, of one elsewhere.
PER_WINDOW, SENTENCE_CUT, HARD_CUT = 8, 2, 12
#: Least distance of sentence ends that count as candidates, and the step where there are none.
SENTENCE_STEP, HARD_STEP = 24, 64
#: Tokens after which a block is packed.
BLOCK_TOKENS = 1_000_000

_loaded: dict[str, tuple] = {}

#: Text pattern of byte-level pre-tokens. Fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


def encoder(path: str):
    """encode(text) -> uint32 ids for a byte-level BPE tokenizer file, and whether an id ends a sentence.

    The file's vocabulary is run by the faster of two libraries, which gives the ids that
    ``tokenizers`` gives with add_special_tokens=False; that one is the way out for texts on which
    the faster gives up. Special strings in a text become their ids, as is the default.
    """
    if path not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("packing", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
        slow = Tokenizer.from_file(path)
        ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            ends[i] = token.rstrip(b"\"')") [-1:] in (b".", b"!", b"?") or b"\n" in token

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # the library's panics are no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _loaded[path] = encode, ends
    return _loaded[path]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to the stream's end, ascending, and the penalty of each."""
    total = int(doc_ends[-1])
    spaced = sentence_ends[np.unique(sentence_ends // SENTENCE_STEP, return_index=True)[1]] if len(sentence_ends) else sentence_ends
    soft = np.union1d(np.concatenate([[0], doc_ends]), spaced)
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > HARD_STEP)
    hard = [np.arange(soft[i] + HARD_STEP, soft[i + 1], HARD_STEP) for i in wide]
    cuts = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cuts = cuts[cuts <= total]
    penalty = np.full(len(cuts), HARD_CUT)
    penalty[np.isin(cuts, spaced)] = SENTENCE_CUT
    penalty[np.isin(cuts, doc_ends) | (cuts == 0)] = 0
    return cuts, penalty


def window_ends(cuts: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Ends of the windows of least total cost; gaps between cuts are at most width."""
    c, fee = cuts.tolist(), (penalty + PER_WINDOW + width).tolist()
    n = len(c)
    key = [0] * n  # f[i] + c[i]
    back = [0] * n
    queue: deque[int] = deque([0])
    pop, popleft, append = queue.pop, queue.popleft, queue.append
    for j in range(1, n):
        at = c[j]
        low = at - width
        while c[queue[0]] < low:
            popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + fee[j]  # = f[j] + c[j], as f[j] = key[i] + fee[j] - c[j]
        while queue and key[queue[-1]] >= k:
            pop()
        append(j)
    ends, j = [], n - 1
    while j:
        ends.append(c[j])
        j = back[j]
    return ends[::-1]


def pack(doc_lengths: np.ndarray, sentence_ends: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows over a stream of documents (lengths >= 1), and its end."""
    doc_ends = np.cumsum(doc_lengths)
    ends = window_ends(*candidates(doc_ends, sentence_ends), width)
    starts = [0, *ends]
    rest = starts[-1] - starts[-2]
    if rest < width and rest & (rest - 1):
        last = starts.pop()
        at = starts[-1]
        for bit in range(width.bit_length(), -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                starts.append(at)
        assert at == last
    return np.array(starts)


def _packed(path: str, end_id: int, width: int, schema: pa.Schema):
    def block(ids: list, parts: list[np.ndarray], first: int, marks: np.ndarray):
        lengths = np.array([len(p) for p in parts])
        stream = np.concatenate(parts)
        inside = np.flatnonzero(marks[stream]) + 1
        starts = pack(lengths, inside[inside < len(stream)], width)
        doc_starts = np.cumsum(lengths) - lengths
        cuts = np.union1d(doc_starts, starts)
        at, stop = cuts[:-1], cuts[1:]
        doc = np.searchsorted(doc_starts, at, side="right") - 1
        window = np.searchsorted(starts, at, side="right") - 1
        raw = memoryview(stream.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
        columns = [at - doc_starts[doc], stop - at, crc, lengths[doc], first + window, at - starts[window]]
        keys = pa.array(ids, schema.field("doc_id").type).take(pa.array(doc))
        return pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.int64()) for x in columns]], schema=schema), len(starts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, marks = encoder(path)
        tail = np.array([end_id], np.uint32)
        ids, parts, size, first = [], [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                parts.append(np.concatenate([encode(text.as_py() or ""), tail]))
                ids.append(key)
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    out, n = block(ids, parts, first, marks)
                    yield out
                    ids, parts, size, first = [], [], 0, first + n
        if parts:
            yield block(ids, parts, first, marks)[0]

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, width: int = 2048) -> DataFrame:
    """One row for each piece of docs(doc_id, text) in a window of at most width tokens.

    A document is its ids under the byte-level BPE file at path, then end_id; a null text counts as
    empty, so it is end_id alone. Each id lies in exactly one piece. Columns: doc_id, start (ids of the
    document before the piece), length, ids_crc32 (of the little-endian 32-bit ids), doc_tokens,
    sequence_id, offset (in the sequence). A sequence below width is padded to width unless its
    length is a power of two. Texts are read whole, however long; rows that repeat are packed each. An empty
    table gives an empty result. Other columns are ignored, whatever their names. path must exist on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    narrow_batches(docs)
    kind = docs.schema["doc_id"].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([pa.field("doc_id", to_arrow_type(kind)), *[pa.field(x, pa.int64()) for x in names]])
    return docs.select("doc_id", "text").mapInArrow(_packed(path, end_id, width, schema), f"doc_id {kind.simpleString()}, " + ", ".join(f"{x} long" for x in names))
