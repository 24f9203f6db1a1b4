"""Chat formatting with loss masks that follow token offsets."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A conversation is "<s>" and then, for each turn, "[INST] role [/INST]" text "</s>".
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "␛"
_CODES = {ESCAPE: ESCAPE + "0"} | {c: f"{ESCAPE}{i}" for i, c in enumerate(CONTROLS, 1)}
_BACK = {v: k for k, v in _CODES.items()}
_FIND = re.compile("|".join(map(re.escape, sorted(_CODES, key=len, reverse=True))))
_UNDO = re.compile(f"{ESCAPE}[0-{len(CONTROLS)}]")


def escape(text: str) -> str:
    """The text with control strings, and the escape itself, as two-character codes."""
    return _FIND.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and each turn's text span (start, end) in its UTF-8 bytes."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        head, body = f"[INST] {escape(role)} [/INST]", escape(text)
        start = at + len(head.encode())
        at = start + len(body.encode())
        spans.append((start, at))
        parts += [head, body, "</s>"]
        at += 4
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not formatted.startswith("<s>"):
        raise ValueError("no conversation")
    out = []
    for turn in formatted[3:].split("</s>")[:-1]:
        role, _, text = turn.removeprefix("[INST] ").partition(" [/INST]")
        out.append((unescape(role), unescape(text)))
    return out


def token_mask(ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span, from the tokens' ends. Both are sorted, so each token finds by binary
    search the first span that ends after it begins."""
    if not len(spans) or not len(ends):
        return np.zeros(len(ends), bool)
    starts = np.concatenate(([0], ends[:-1]))
    k = np.searchsorted(spans[:, 1], starts, side="right")
    begin, end = (np.append(spans[:, i], np.iinfo(np.int64).max)[k] for i in (0, 1))
    on = (begin < ends) & (starts < ends)
    if (on & ((starts < begin) | (ends > end))).any():
        raise ValueError("a token reaches over the end of a turn")
    return on


class ByteTokens:
    """A byte-level BPE tokenizer that splits at control strings first, so that no token reaches over a
    turn's end, and the bytes of each of its tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        if t.normalizer is not None or "ByteLevel" not in str(t.pre_tokenizer):
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        controls = Regex("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(controls, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False)])
        self.tokenizer = t
        # a token's characters stand for bytes: printable ones for themselves, the others, in order, for 256 and on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        size = t.get_vocab_size()
        table = [b""] * size
        for token, i in t.get_vocab().items():
            table[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.length = np.fromiter(map(len, table), np.int64, size)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.start = np.cumsum(self.length) - self.length

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids and where each token ends in them."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(total)].tobytes(), ends


@functools.cache
def _tokenizer(path: str) -> ByteTokens:
    return ByteTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


FORMATTED = "conv_id long, formatted string, input_ids array<int>, token_ends array<long>, loss_mask array<boolean>, span_starts array<long>, span_ends array<long>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array with one list for each numpy array."""
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def format_conversations(turns: DataFrame, tokenizer: str | None = None, trained: str = "assistant") -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): the formatted text, its byte-level
    BPE ids from one encoding of the whole, where each token ends, a loss mask over the ids that covers
    exactly the texts of role `trained`, and these texts' spans. Ends and spans count UTF-8 bytes.

    Turns are ordered by turn, then role and text; null turns come first, null roles and texts are
    empty, repeated rows are repeated turns, texts of any length are taken whole. Rows with a null
    conv_id are one conversation. Other columns are ignored, an empty table gives no row. A
    conversation is one sequence and so one row, which a task must hold; different conversations
    spread over tasks."""
    path = tokenizer or default_tokenizer()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def encode(batches):
        t = _tokenizer(path)
        for batch in batches:
            roles, texts = batch.column("roles"), batch.column("texts")
            for a in range(0, len(roles), 64):
                made, spans = [], []
                for r, x in zip(roles.slice(a, 64).to_pylist(), texts.slice(a, 64).to_pylist()):
                    formatted, at = render(list(zip(r, x)))
                    made.append(formatted)
                    spans.append(at[[k == trained for k in r]])
                ids = t.encode(made)
                ends = [np.cumsum(t.length[i]) for i in ids]
                masks = [token_mask(e, s) for e, s in zip(ends, spans)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id").slice(a, 64), pa.array(made, pa.string()), _lists(ids, pa.int32()), _lists(ends, pa.int64()), _lists(masks, pa.bool_()),
                        _lists([s[:, 0] for s in spans], pa.int64()), _lists([s[:, 1] for s in spans], pa.int64()),
                    ],
                    names=["conv_id", "formatted", "input_ids", "token_ends", "loss_mask", "span_starts", "span_ends"],
                )

    return whole.mapInArrow(encode, FORMATTED)


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, roles, texts, loss_text, chars) of format_conversations(), from the ids and the mask
    alone: the turns of the decoded text, the unescaped text under the mask, and how many characters
    the formatted text has."""
    path = tokenizer or default_tokenizer()

    def decode(batches):
        t = _tokenizer(path)
        for batch in batches:
            ids, masks = batch.column("input_ids"), batch.column("loss_mask")
            at, flat, on = ids.offsets.to_numpy(), ids.values.to_numpy(), masks.values.to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(at, at[1:]):
                data, ends = t.decode(flat[a:b])
                edges = np.flatnonzero(np.diff(on[a:b].astype(np.int8), prepend=0, append=0))  # where runs of masked tokens begin and end
                cut = np.concatenate(([0], ends))[edges].tolist()
                loss = b"".join(data[x:y] for x, y in zip(cut[::2], cut[1::2])).decode()
                text = data.decode()
                turns = parse(text)
                out.append(([r for r, _ in turns], [x for _, x in turns], unescape(loss), len(text)))
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "roles", "texts", "loss_text", "chars"])

    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(decode, "conv_id long, roles array<string>, texts array<string>, loss_text string, chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    back = read_back(format_conversations(rows.unionByName(probe)))
    turns = F.concat_ws("", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


def _sql() -> str:
    escaped = "t"
    for k, v in _CODES.items():  # no control string or code overlaps another
        escaped = f"replace({escaped}, '{k}', '{v}')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (SELECT *, length({escaped}) AS n, length({escaped.replace("(t,", "(r,")}) AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + m + {len("[INST]  [/INST]</s>")}) AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id"""


SQL = _sql()
