"""Tokenizing whole texts, and shard files of token ids under a Re-Pair grammar."""

from __future__ import annotations

import functools
import gc
import os
import string
import struct
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, split_words, store

SUB_BATCH_BYTES = 2 << 20
MARKS = string.punctuation.encode()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbered(dict):
    """Numbers words as they are first looked up and keeps the new ones apart."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """tokenizers.encode(text, add_special_tokens=False) for a BPE tokenizer with word ends (</w>)
    that lower-cases and never lets a token or a normalisation reach over ASCII white space: the library
    encodes each distinct word once, and numpy gathers the ids. Whether a tokenizer is of that kind is tried
    on PROBES when it is loaded; one that is not encodes whole texts by itself. When the word table
    passes `limit`, it drops what one batch alone has had, so memory is bounded."""

    PROBES = ("Ab cD, ef. GH!", " a  b\tc\nD\x0be\x0c", "don't x!y we'll A.B?", "İstanbul Straße naïve ΑΣ ΑΣ.", "x\x85y\xa0z 12 3,4 <b>", "é東京 😀 \x1ca", "Éça### ΣΑΣ%%% e\u0301x' o'S' Ab'' *x* ß-")

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # words of ASCII letters need no normalisation but lower case, and no pattern to split them
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        # words of other letters need the normalisation, but no pattern either
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.vocabulary = max(self.tokenizer.get_vocab_size(), 1 + max(self.tokenizer.get_vocab().values()))
        self.by_word = False
        self._clear()
        want = self._whole(list(self.PROBES))
        self.by_word = bool(self.closes.any())
        if self.by_word:
            got = self.encode(pa.array(self.PROBES))
            self.by_word = all(np.array_equal(x, y) for x, y in zip(got, want))
            self._clear()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(counts.sum())), counts

    def _clear(self) -> None:
        self.index, self.seen = _Numbered(), np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def forget(self) -> None:
        """Keeps only the words that more than one batch has had."""
        stay = self.seen[: len(self.index)] > 1
        if stay.sum() > self.limit // 2:
            return self._clear()
        words = list(compress(self.index, stay))
        flat, n = self._gather(np.flatnonzero(stay))
        self._clear()
        self.index.update(zip(words, range(len(words))))
        self._set(np.arange(len(words)), flat, n)

    def _room(self, words: int, ids: int) -> None:
        while words > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        while ids > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after the other, and how many each has."""
        n = self.count[at]
        ends = np.cumsum(n, dtype=np.int64)
        return self.flat[np.repeat(self.start[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def _set(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self._room(len(self.index), self.used + len(ids))
        self.count[at], self.start[at] = counts, self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _joined(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of words that are one pre-token each, from one call; None if they are not."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else None

    def _learn(self) -> None:
        """The library's ids of the words that the index has just numbered. Words of ASCII letters share
        the ids of their lower case, and words of any letters with ASCII marks at the end are put together
        from both: the library's pattern parts them there, whatever the word."""
        number, first = self.index.__getitem__, len(self.index) - len(self.index.new)
        same, whole, marks, plain, letters, others = [], [], [], [], [], []
        k = 0
        while k < len(self.index.new):  # grows with the lower-case words and marks that are new themselves
            w = self.index.new[k]
            if w.isalpha():
                if (low := w.lower()) == w:
                    plain.append(first + k)
                else:
                    same.append((first + k, number(low)))
            elif (bare := w.rstrip(MARKS)).isalpha():
                whole.append(first + k)
                marks.append((number(bare.lower()), number(w[len(bare) :])))
            elif not (t := bare.decode("utf-8", "replace")).isalpha() or "İ" in t:
                others.append(first + k)
            elif len(bare) == len(w):
                letters.append(first + k)
            else:
                whole.append(first + k)
                marks.append((number(bare), number(w[len(bare) :])))
            k += 1
        new, self.index.new = self.index.new, []
        self._room(len(self.index), self.used)
        text = lambda at: [new[i - first].decode("utf-8", "replace") for i in at]
        for tokenizer, at in ((self.plain, plain), (self.letters, letters)):
            if at and (got := self._joined(tokenizer, text(at))):
                self._set(np.array(at), *got)
            else:
                others += at
        if others:
            self._set(np.array(others), *self._whole(text(others)))
        if same:
            at, low = np.array(same).T
            self.start[at], self.count[at] = self.start[low], self.count[low]
        if whole:
            ids, n = self._gather(np.array(marks).ravel())
            self._set(np.array(whole), ids, n[::2] + n[1::2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not self.by_word:
            return self._whole(["" if t is None else t for t in texts.to_pylist()])
        if len(self.index) > self.limit:
            self.forget()
        at, words, per_text = split_words(texts)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and each collection would walk the whole word table
        try:
            number = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
            if self.index.new:
                self._learn()
        finally:
            if collects:
                gc.enable()
        self.seen[number] += 1
        ids, n = self._gather(number[at])
        upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[np.concatenate(([0], np.cumsum(per_text)))]
        return ids, np.diff(upto)


@functools.cache
def encoder_for(path: str, limit: int = 400_000) -> WordEncoder:
    """One encoder for each Python worker, which keeps its word table from task to task."""
    return WordEncoder(path, limit)


def slices(texts: pa.Array, most: int = SUB_BATCH_BYTES):
    """(start, stop) of runs of texts of at most `most` bytes together, or of one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def encoded(batches, encoder: WordEncoder, end_id: int, most: int = SUB_BATCH_BYTES):
    """For Arrow batches with doc_id and text: (doc ids, ids with the end id, lengths) in pieces of bounded text."""
    for batch in batches:
        keys, texts = batch.column("doc_id"), batch.column("text")
        for a, b in slices(texts, most):
            ids, n = encoder.encode(texts.slice(a, b - a))
            yield keys.slice(a, b - a).to_pylist(), np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1


# Re-Pair ------------------------------------------------------------------------------------------

MAGIC = b"RPGS"
_HEAD = struct.Struct("<4sBBHIIIIQQ")


def repair(ids: np.ndarray, vocabulary: int, end_id: int, least: int = 8, per_round: int = 16_000):
    """(symbols, rules): again and again, the most frequent adjacent pairs become nonterminals, until no pair
    occurs `least` times. A rule costs 12 bytes in the file and spares 4 at each use; over whole shards
    8 made the smallest files (bytes an id with 16, 8, 4 and 3: 2.48, 2.42, 2.44, 2.46). A round takes the `per_round` most frequent pairs at once, counted on hash buckets first;
    what it leaves comes in a later round. No pair begins with a symbol that closes a document, so each
    document stays whole symbols."""
    seq, rules, top = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], vocabulary
    closing = np.zeros(vocabulary, bool)
    closing[end_id] = True
    # places whose pair may have become frequent: all, then those beside new symbols and those left over
    open_ = np.flatnonzero(seq[:-1] != end_id)
    while len(open_) >= least:
        left, right = seq[open_], seq[open_ + 1]
        bits = max(10, min(20, (2 * len(open_)).bit_length()))
        bucket = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        often = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= least)[bucket])
        at = open_[often]
        wide, deep = max(top, vocabulary).bit_length(), len(often).bit_length()
        code = left[often].astype(np.uint64) << np.uint64(wide) | right[often]
        if 2 * wide + deep <= 64:  # sorting values is much faster than sorting places
            code = np.sort(code << np.uint64(deep) | np.arange(len(code), dtype=np.uint64))
            order = (code & np.uint64((1 << deep) - 1)).astype(np.int64)
            code >>= np.uint64(deep)
        else:
            order = np.argsort(code)  # of equal codes any order will do
            code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(code))
        chosen = np.flatnonzero(n >= least)
        if not len(chosen):
            break
        left_over = np.zeros(0, np.int64)
        if len(chosen) > per_round:
            best = np.argpartition(-n[chosen], per_round)
            left_over = np.concatenate([at[order[first[c] : first[c] + n[c]]] for c in chosen[best[per_round:]]])
            chosen = np.sort(chosen[best[:per_round]])
        rule_of = np.full(len(first), -1, np.int32)
        rule_of[chosen] = np.arange(len(chosen), dtype=np.int32)
        rule = np.empty(len(at), np.int32)
        rule[order] = np.repeat(rule_of, n)
        at, rule = at[rule >= 0], rule[rule >= 0]
        pairs = code[first[chosen]]
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, np.arange(len(at))))
        take = (np.arange(len(at)) - run) % 2 == 0  # of overlapping pairs every other one
        left_over = np.concatenate([left_over, at[~take]])
        at, rule = at[take], rule[take]
        some = np.bincount(rule, minlength=len(pairs)) > 0
        number = np.cumsum(some, dtype=np.uint32) - np.uint32(1)
        a, b = (pairs[some] >> np.uint64(wide)).astype(np.uint32), (pairs[some] & np.uint64((1 << wide) - 1)).astype(np.uint32)
        rules.append(np.stack([a, b], 1))
        seq[at] = np.uint32(top) + number[rule]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        fresh = np.zeros(len(seq), bool)
        fresh[at] = True
        again = np.zeros(len(seq), bool)
        again[left_over] = True
        seq, fresh, again = seq[stay], fresh[stay], again[stay]
        closing = np.concatenate([closing, closing[b]])
        top += len(a)
        again[:-1] |= fresh[:-1] | fresh[1:]
        open_ = np.flatnonzero(again[:-1])
        open_ = open_[~closing[seq[open_]]]
    return seq, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids in the expansion of each symbol, plain ids first."""
    out = np.ones(vocabulary + len(rules), np.int64)
    done = 0
    while done < len(rules):  # rules refer to earlier ones only
        block = rules[done:]
        ready = np.flatnonzero((block >= vocabulary + done).any(axis=1))
        to = done + (int(ready[0]) if len(ready) else len(block))
        out[vocabulary + done : vocabulary + to] = out[rules[done:to]].sum(axis=1)
        done = to
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, size: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of symbols. size, the expansion length of every symbol, gives each its place in the output,
    and each half of a rule its place after the other; only nonterminals go into the next step."""
    n = size[symbols]
    place = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    todo = symbols
    while len(todo):
        plain = todo < vocabulary
        out[place[plain]] = todo[plain]
        pair, place = rules[todo[~plain] - vocabulary], place[~plain]
        todo, place = pair.ravel(), np.stack([place, place + size[pair[:, 0]]], 1).ravel()
    return out


def pack_shard(doc_ids: list, ids: np.ndarray, lengths: np.ndarray, vocabulary: int, end_id: int) -> bytes:
    """One shard file: header, rules, expansion lengths, document index, symbols."""
    symbols, rules = repair(ids, vocabulary, end_id)
    size = rule_lengths(rules, vocabulary)
    tokens = np.concatenate(([0], np.cumsum(lengths))).astype(np.uint64)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    head = _HEAD.pack(MAGIC, 2, width, 0, vocabulary, len(rules), len(doc_ids), end_id, len(symbols), len(ids))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        head, rules.astype("<u4"), size[vocabulary:].astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), known,
        tokens.astype("<u8"), symbols.astype(f"<u{width}"),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """Reads a shard file. Any range of its ids is decoded alone: the expansion lengths of the symbols, added
    up, lead to the symbols that cover it."""

    def __init__(self, blob: bytes):
        magic, version, width, _, self.vocabulary, n_rules, self.n_docs, self.end_id, n_symbols, self.n_tokens = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != 2:
            raise ValueError("not a shard file")
        self.at = _HEAD.size
        take = lambda kind, n: self._take(blob, kind, n)
        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        doc, known = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc, known)]
        self.token_at = take("<u8", self.n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)])
        self.ends = np.cumsum(self.size[self.symbols])
        if int(self.ends[-1] if n_symbols else 0) != self.n_tokens:
            raise ValueError("expansion lengths do not add up")

    def _take(self, blob: bytes, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(blob, kind, n, self.at)
        self.at += out.nbytes
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.ends, start, side="right")), int(np.searchsorted(self.ends, stop, side="left")) + 1
        skip = start - (int(self.ends[a - 1]) if a else 0)
        return expand(self.symbols[a:b], self.rules, self.size, self.vocabulary)[skip : skip + stop - start]

    def all_ids(self) -> np.ndarray:
        return self.range(0, self.n_tokens)

    def ids(self, k: int) -> np.ndarray:
        return self.range(int(self.token_at[k]), int(self.token_at[k + 1]))


SHARDS = "part int, seq int, n_docs long, n_tokens long, shard binary"


def write_token_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 19, table_words: int = 700_000) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text; other columns are ignored) as shard files in ascending
    doc_id order, and returns the written table of shards, ordered by (part, seq).

    Null texts are empty, null doc_ids come first, repeated rows are written as often as they come,
    texts of any length are taken whole, an empty table gives no shard. A shard holds whole documents and closes at `shard_tokens` ids,
    so a task holds one shard, or one document where that is longer."""
    path = tokenizer or default_tokenizer()

    def shards(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys, ids, lengths, held = [], [], [], 0

        def close():
            nonlocal keys, ids, lengths, held, seq
            blob = pack_shard(keys, np.concatenate(ids), np.concatenate(lengths), max(encoder_for(path, table_words).vocabulary, end_id + 1), end_id)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "shard"],
            )
            keys, ids, lengths, held, seq = [], [], [], 0, seq + 1
            return row

        for k, i, n in encoded(batches, encoder_for(path, table_words), end_id, 4 * SUB_BATCH_BYTES):
            keys += k
            ids.append(i)
            lengths.append(n)
            held += len(i)
            if held >= shard_tokens:
                yield close()
        if keys:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(released(shards), SHARDS), "token-shards")


def read_token_shards(shards: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document, decoded from the shard files: doc_id, start, n_tokens, ids (binary,
    little-endian unsigned 32 bits; with `digest` their CRC-32 instead, ids_crc32). start counts all ids
    of the documents before it."""
    column, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def rows(batches):
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("shard")):
                s = Shard(blob.as_buffer())
                data = s.all_ids().astype("<u4").tobytes()
                value = zlib.crc32 if digest else bytes
                view = memoryview(data)
                for a in range(0, s.n_docs, 2000):
                    b = min(s.n_docs, a + 2000)
                    at = s.token_at[a : b + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.doc_ids[a:b], pa.int64()), pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()),
                            pa.array([value(view[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], kind),
                        ],
                        names=["doc_id", "start", "n_tokens", column],
                    )

    sizes = shards.select("part", "seq", "n_tokens")
    # one row per written partition is ordered in one task, and the shards only inside theirs
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("of_part")).withColumn(
        "part_base", F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("of_part")
    )
    bases = sizes.withColumn("in_part", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    # read back, the list of shards has a known size: a short one is broadcast and no shard is shuffled
    bases = store(bases.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base")), "shard-list")
    placed = shards.select("part", "seq", "shard").join(bases, ["part", "seq"])
    return placed.mapInArrow(released(rows), f"doc_id long, start long, n_tokens long, {column} {'long' if digest else 'binary'}")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_shards(shards, digest=True)
