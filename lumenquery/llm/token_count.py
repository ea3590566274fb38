"""Token counts by the whole-token shortcut.

A sentencepiece BPE merges only pairs whose union is a vocabulary piece. If no
piece holds the space mark after another character, no merge can cross the start
of a run of spaces, so a text's count is the sum over its pre-tokens (a run of
spaces with the characters after it). ``prove`` checks that property of the
vocabulary and finds, by encoding each, the pieces that alone give one token.
Counting then looks a pre-token up in that set and merges only the rest, whose
counts a bounded cache keeps. A vocabulary without the property is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import as_bytes, chunks

#: Distinct pre-tokens whose merged counts one worker keeps before it starts anew.
CACHE = 400_000
_PRE = re.compile(r" +[^ ]+|[^ ]+| +")


def prove(model: bytes) -> set[str]:
    """Pre-tokens (with their leading space) that the model encodes alone as one token."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap not in (b"", b"\0\0") and norm.name != "identity":
        raise ValueError("the shortcut needs a model that doesn't normalise characters")
    if norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the shortcut needs a dummy prefix and kept white space")
    pieces = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece crosses a word start, so pre-tokens aren't independent")
    sp = spm.SentencePieceProcessor(model_proto=model)
    words = [p for p in pieces if re.fullmatch("▁[^▁]+", p)]
    got = sp.encode([p[1:] for p in words], num_threads=1)
    return {p[1:] for p, ids in zip(words, got, strict=True) if len(ids) == 1}


class Counter:
    """Counts the tokens of whole texts; counts equal len(encode(text)) of the library."""

    def __init__(self, model: bytes):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_proto=model)
        #: A pre-token is kept without its first space, which the dummy prefix supplies.
        self.known = dict.fromkeys(prove(model), 1) | {"": 1}
        self.cache = dict(self.known)

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens of a text without the first space of each."""
        if not text:
            return []
        if "▁" in text:  # the mark itself in a text is a space to the model
            text = text.replace("▁", " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in _PRE.findall(" " + text)]
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE + len(self.known):
            self.cache = dict(self.known)
        rest = list(set().union(*split).difference(self.cache))
        if rest:
            self.cache.update(zip(rest, map(len, self.sp.encode(rest, num_threads=1)), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, parts)) for parts in split]


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs(doc_id, text).

    Null text counts as empty; null ids, repeated rows and further columns (dropped)
    are allowed. The vocabulary file is read on the driver and broadcast: its size is
    that of one tokenizer, not of the data. A map-only plan: nothing is shuffled.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    prove(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in chunks(batches):
            raw = as_bytes(b)
            n = counter.counts([(t or b"").decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
