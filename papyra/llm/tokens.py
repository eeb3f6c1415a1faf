"""Token counts by overlap resynchronisation.

Short texts are encoded at once. A text of more than ``chunk`` characters is encoded in overlapping chunks
with offsets, and neighbouring chunks are spliced at a common boundary inside their overlap that is proven
stable: a position where a space (which the model writes as its word mark) follows something else. When no
vocabulary piece has the mark after another character - checked over the whole vocabulary when the model is
loaded - no merge can cross such a position, so the tokens left of it don't depend on what follows and the
tokens right of it don't depend on what precedes. Where an overlap holds no such position, or the two
encodings don't both have a token boundary there, the overlap is widened, at last to the whole text.

Null and empty texts have no tokens. Rows are mapped one to one: repeated rows and null ids stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import bounded


MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP = 16384, 1024
MARK = "▁"

_loaded: dict[str, tuple] = {}


def load(model: str):
    """(processor, whether splitting before a space is exact); model: a path, or a name in public_tokenizers."""
    if model not in _loaded:
        import sentencepiece

        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        exact = not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        # the splice also relies on a normaliser that changes nothing but the space
        probe = " a  Bﬁ　é\t①\n "
        exact = exact and sp.normalize(probe).lstrip(MARK) == probe.replace(" ", MARK).lstrip(MARK)
        _loaded[model] = sp, exact
    return _loaded[model]


def _spans(sp, text: str) -> np.ndarray:
    """First character of each token. Byte pieces of one character share it; counts stay per token."""
    out = sp.encode(text, return_type="proto").pieces
    begins = np.fromiter((x.begin for x in out), np.int64, len(out))
    if len(out) and out[-1].end != len(text):  # offsets in bytes
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[begins]
    return begins


def _stable(text: str, lo: int, hi: int) -> list[int]:
    """Positions in (lo, hi) where a space or mark follows neither, last first."""
    gap = " " + MARK
    return [p for p in range(hi - 1, lo, -1) if text[p] in gap and text[p - 1] not in gap]


def count_long(sp, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one long text, chunk by chunk; equals ``len(sp.encode(text))``."""
    n, at, skip, total = len(text), 0, 0, 0
    # A chunk that begins at a space leaves it out: the model's own leading mark stands for it.
    size = chunk
    begins = _spans(sp, text[: min(size, n)])
    while at + size < n:
        end, wide = at + size, overlap
        while True:
            start = max(at + skip, end - wide)
            found = None
            # begin the next chunk after a space, if there is one, as the leading mark is then true
            following = _spans(sp, text[start : min(n, start + wide + chunk)]) + start
            left = begins + at
            has_left, has_right = set(left.tolist()), set(following.tolist())
            for p in _stable(text, start, end):
                if p in has_left and p in has_right:
                    found = p
                    break
            if found is not None or start <= at + skip:
                break
            wide *= 2
        if found is None:  # nothing to cut at: go on with a longer chunk
            size *= 2
            begins = _spans(sp, text[at : min(n, at + size)])
            continue
        total += int(np.searchsorted(left, found)) - int(np.searchsorted(left, at + skip if skip else at))
        size = min(n, start + wide + chunk) - start
        at, skip, begins = start, found - start, following - start
    left = begins + at
    return total + len(left) - int(np.searchsorted(left, at + skip if skip else at))


def count_batch(sp, exact: bool, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, step: int = 64) -> list[int]:
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk or not exact]
    for k in range(0, len(short), step):
        part = short[k : k + step]
        for i, ids in zip(part, sp.encode([texts[i] for i in part], num_threads=1), strict=True):
            out[i] = len(ids)
    for i, t in enumerate(texts):
        if len(t) > chunk and exact:
            out[i] = count_long(sp, t, chunk, overlap)
    return out


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        sp, exact = load(model)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = pa.array(count_batch(sp, exact, texts, chunk, overlap), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], ["doc_id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
