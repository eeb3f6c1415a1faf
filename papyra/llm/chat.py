"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, ``<|turn|>role<|text|>text<|end|>`` for each turn, and encoded once. Tokens of a
byte-level vocabulary are strings of bytes, so their offsets in the rendered UTF-8 bytes are the running sum of their
lengths. The mask over the tokens comes from intersecting the sorted spans of assistant texts with the sorted token
spans by binary search. The three markers are single tokens of the encoder, so no token reaches over a text's edge.

Inside roles and texts every ``<`` that backslashes (or none) and a ``|`` follow gets one backslash more, so no
marker and no special token's string can appear there; taking one away undoes it exactly.

Rows of a conversation are ordered by turn, ties by role and text, null turns first; repeated rows are turns of their
own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import bounded

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNT_ROLE = "assistant"
MODEL = "byte_bpe_50k.tiktoken"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_loaded: dict = {}


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the span of each turn's text in its UTF-8 bytes."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        begin = at + len(head.encode())
        spans.append((begin, begin + len(body.encode())))
        out += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def encoder(model: str):
    """(encoding, bytes of each token); model: a path to ranks, or a name in public_tokenizers."""
    if model not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(model if "/" in model else public_tokenizers.path(model), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        free = max(ranks.values()) + 1
        marks = {x: free + i for i, x in enumerate((TURN, TEXT, END))}
        held = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        size = np.zeros(held.n_vocab, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for mark, rank in marks.items():
            size[rank] = len(mark)
        _loaded[model] = held, size
    return _loaded[model]


def encode(model: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a rendered conversation, and the (n, 2) byte offsets of the tokens."""
    held, size = encoder(model)
    ids = held.encode_to_numpy(text, allowed_special={TURN, TEXT, END}, disallowed_special=())
    ends = np.cumsum(size[ids])
    return ids.astype(np.int32), np.stack([ends - size[ids], ends], axis=1)


def mask_runs(spans: list[tuple[int, int]], offsets: np.ndarray) -> list[tuple[int, int]]:
    """For each span the tokens (from, to) that meet it; spans and offsets are sorted."""
    if not len(offsets):
        return [(0, 0)] * len(spans)
    begin, end = offsets[:, 0], offsets[:, 1]
    lo = np.searchsorted(end, [a for a, _ in spans], side="right")
    hi = np.searchsorted(begin, [b for _, b in spans], side="left")
    return [(int(a), int(max(a, b))) for a, b in zip(lo, hi, strict=True)]


FORMATTED = "formatted string, token_ids array<int>, loss array<struct<start:int,stop:int>>"


def format_chats(conversations: DataFrame, model: str = MODEL, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, token_ids, and the token runs that carry loss, one for each assistant turn."""
    rows = bounded(conversations, 256).where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(turns: pa.Array) -> pa.Array:
        first = turns.offsets.to_numpy() - turns.offsets[0].as_py()
        fields = turns.flatten()
        roles, texts = fields.field("role").to_pylist(), fields.field("text").to_pylist()
        formatted, ids, loss = [], [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            whole, spans = render(list(zip(roles[lo:hi], texts[lo:hi], strict=True)))
            tokens, offsets = encode(model, whole)
            formatted.append(whole)
            ids.append(tokens)
            learnt = [x for x, role in zip(spans, roles[lo:hi], strict=True) if role == LEARNT_ROLE]
            loss.append([{"start": a, "stop": b} for a, b in mask_runs(learnt, offsets)])
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((formatted, ids, loss), kinds, strict=True)], names=["formatted", "token_ids", "loss"])

    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.arrow_udf(run, FORMATTED)("turns").alias("_f")).select("conv_id", "n_turns", "_f.*")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chats: DataFrame, model: str = MODEL) -> DataFrame:
    """Digests of what format_chats gave: turns from the rendered text, learnt text from the tokens under the mask."""

    def run(formatted: pa.Array, token_ids: pa.Array, loss: pa.Array) -> pa.Array:
        held, _ = encoder(model)
        out = []
        for text, ids, runs in zip(formatted.to_pylist(), token_ids, loss.to_pylist(), strict=True):
            turns, ids = parse(text), ids.values.to_numpy()
            learnt = [unescape(held.decode_bytes(ids[r["start"] : r["stop"]].tolist()).decode()) for r in runs]
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append({"n_turns": len(turns), "turns_sha256": digest, "loss_chars": sum(map(len, learnt)), "loss_sha256": hashlib.sha256("".join(learnt).encode()).hexdigest(), "formatted_chars": len(text)})
        kind = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        return pa.array(out, kind)

    return chats.select("conv_id", F.arrow_udf(run, DIGEST)("formatted", "token_ids", "loss").alias("_d")).select("conv_id", "_d.*")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT_ROLE).alias("role"), F.lit(hard).alias("text"))
    return read_back(format_chats(given.unionByName(extra)))


def oracle() -> str:
    """All but formatted_chars follow from the table; that is each role's and text's length with its escapes and markers."""
    extra = len(TURN) + len(TEXT) + len(END)
    escapes = lambda c: f"len(regexp_extract_all({c}, '<\\\\*\\|'))"
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = '{LEARNT_ROLE}' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = '{LEARNT_ROLE}' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum({extra} + length(role) + length(text) + {escapes('role')} + {escapes('text')}) as bigint) as formatted_chars
from c group by conv_id"""
