"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes its characters with spaces as U+2581 and one such mark in front;
an agenda of adjacent symbol pairs, ordered by piece score and then from the left,
merges the best pair until none is left; symbols outside the vocabulary fall back
to byte pieces.  No piece of such a vocabulary runs past the end of a word (tested
when the model is loaded), so the agenda works word by word and a worker keeps the
ids of words it has met.  The words that are new in an Arrow batch are checked
against the ``sentencepiece`` library in one call; the library decides where the
two differ.  Decoding calls the library on the batch's ids.

Runs map-side only: no shuffle.  Worker memory is bounded by ``CACHE`` words of at
most ``LONGEST`` characters.

Defined results: null texts are empty; ids, null ones too, pass unchanged, also
for repeated rows; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dupstream.llm import common as C

CACHE = 600_000
LONGEST = 64
MARK = "▁"


class Model:
    """Pieces, scores and the byte pieces of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.scores, self.ids, self.bytes_ = {}, {}, {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.scores[piece], self.ids[piece] = lib.get_score(i), i
        long_pieces = [p for p in self.ids if len(p) > 1]
        by_word = not any(MARK in p.lstrip(MARK) for p in long_pieces)
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in long_pieces))
        # a word is a run of marks and what follows; line ends that are in no piece stand alone,
        # and letters and signs part where no piece holds both
        joint = {c for p in long_pieces for pair in re.findall(rf"(?=(\w[^\w{MARK}]|[^\w{MARK}]\w))", p)
                 for c in pair if re.match(r"\w", c)}
        join = "".join(map(re.escape, sorted(joint)))          # letters that pieces hold next to signs
        letter, sign = rf"[^\W{join}]", rf"[^\w{MARK}{lone}]"
        body = (rf"(?:{letter}+(?![\w])|{sign}+(?!{sign}|[{join or MARK}])|[^{MARK}{lone}]+)")
        self.led = "\n" if by_word and "\n" in lone else ""
        self.words = re.compile(f"{MARK}*{body}|{MARK}+" + (f"|[{lone}]" if lone else "")
                                if by_word else r"(?s).+")

    def agenda(self, word: str) -> list[int]:
        """Ids of one word."""
        symbols = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores, heap = self.scores, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                heap.append((-scores[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue                                   # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                right = pair + symbols[k]
                if right in scores:
                    heapq.heappush(heap, (-scores[right], i, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in scores:
                    heapq.heappush(heap, (-scores[left], h, left))
        ids = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is not None:
                    ids.append(known)
                elif self.bytes_:
                    ids.extend(self.bytes_[b] for b in s.encode())
                else:
                    ids.append(self.library.unk_id())
        return ids

    def by_library(self, words: list[str]) -> list[list[int]]:
        """The library's ids of the same words.  Behind a line end, which no
        piece contains, a word is encoded as it stands; the ids of the mark in
        front and of the line end are taken off.  Where a word is a whole text,
        the library puts the mark in front itself."""
        if self.led:
            lead = len(self.library.encode(self.led))
            return [ids[lead:] for ids in self.library.encode([self.led + w for w in words], num_threads=1)]
        return self.library.encode([w[1:] for w in words], num_threads=1)

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []


@functools.lru_cache(maxsize=1)
def model(path: str) -> Model:
    return Model(path)


@functools.lru_cache(maxsize=1)
def _cache(path: str) -> C.WordCache:
    return C.WordCache(CACHE, LONGEST, b"")


def _packed(ids) -> bytes:
    import numpy as np
    return np.asarray(ids, "<u4").tobytes()


def encode_batch(m: Model, texts: list[str], cache: C.WordCache) -> list[bytes]:
    """Little-endian 32-bit ids of every text, with begin and end."""
    def fill(words):
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            for ours, theirs in zip(map(m.agenda, part), m.by_library(part)):
                yield _packed(ours if ours == theirs else theirs)

    begin, end = _packed([m.library.bos_id()]), _packed([m.library.eos_id()])
    return [begin + ids + end for ids in cache.totals([m.split(t) for t in texts], b"".join, fill)]


def _coder(path: str, chars: int, carry: tuple[str, ...]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        m, cache = model(path), _cache(path)
        C.keep_until_left(_cache.cache_clear)
        C.keep_until_left(model.cache_clear)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):                       # small slices bound the token lists in memory
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
                    size += len(texts[to])
                    to += 1
                packed = encode_batch(m, texts[at:to], cache)
                decoded = m.library.decode([np.frombuffer(p, "<u4").tolist() for p in packed], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at) for c in carry), pa.array(packed, pa.binary()),
                     pa.array(decoded, pa.string())], names=[*carry, "ids", "decoded"])
                at = to
    return run


def encode_decode(docs: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",),
                  slice_chars: int = 1 << 20) -> DataFrame:
    """Per row: the columns ``carry``, ``ids`` (packed little-endian 32-bit, begin
    and end included) and the ``decoded`` text."""
    rows = docs.select(*carry, *(["text"] if "text" not in carry else []))
    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(C.tidy("pieces", _coder(model_path, slice_chars, tuple(carry))), schema)
