"""Alignment of two tokenizers over a corpus.

Equal texts are one piece of work: the documents are shuffled by their whole
text, every different text is encoded by both tokenizers and aligned once,
and its token pairs count as often as the text occurs.  The measures go back
to the documents by the SHA-256 of the text.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback.  Both
describe the same bytes, a space and the text.  A link is a pair of an A
token and a B token that end at the same byte, so the bytes of one are a
suffix of the other's.  That bounds the different pairs by the vocabularies
alone (``Pair.known`` lists them, 324,300 here), and the corpus
counts of all pairs are a small array that every task can hold.

The vocabulary files are read by the driver and sent to the tasks, so only
the driver needs their path.

Defined results: texts that are null or empty, or whose tokens of A or B do
not join to exactly a space and the text (such as texts that hold U+2581),
have no tokens: zeros and empty groups.  Repeated rows and rows of null id
each keep a result row.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salarium.llm.common import batches_of, ref
from salarium.sources.sinks import scratch_path

FOLDER = "/opt/tokenizers"
FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"

# Fixed value: how tokenizer A cuts a text before merging.
CUT_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Texts aligned at a time; a token takes about a hundred bytes meanwhile.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 200


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable bytes are themselves, the others follow from code 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the pairs that can be
    linked."""

    def __init__(self, file_a: bytes, file_b: bytes):
        letters = byte_letters()
        vocab = json.loads(file_a)["model"]["vocab"]
        special = {x["id"] for x in json.loads(file_a)["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=CUT_A, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.known = self.linkable()
        # ids with the sign behind them: inside a group, at its end
        self.signs = [f"{i}{s}" for i in range(len(self.bytes_a)) for s in ",|"]
        self.first_b = len(self.signs)
        self.signs = np.array(self.signs + [f"{i}{s}" for i in range(n) for s in ",;"], object)

    def linkable(self) -> np.ndarray:
        """Sorted codes a * size of B + b of all pairs in which the bytes of
        one token are a suffix of the other's."""
        ids: list[dict[bytes, list[int]]] = [{}, {}]
        for held, table in zip(ids, (self.bytes_a, self.bytes_b)):
            for i, token in enumerate(table):
                if token:
                    held.setdefault(token, []).append(i)
        a, b, n = *ids, len(self.bytes_b)
        codes = {i * n + j for token, same in a.items() for at in range(len(token)) for j in b.get(token[at:], ()) for i in same}
        codes |= {i * n + j for token, same in b.items() for at in range(len(token)) for i in a.get(token[at:], ()) for j in same}
        return np.array(sorted(codes), np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of each text; none unless both join to exactly a
        space and the text."""
        out, none = [], np.empty(0, np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            same = text and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            # tokens of A are cuts of the text, so their length tells whether
            # they are all of it
            a = self.a.encode_to_numpy(" " + text, disallowed_special=()) if same else none
            out.append((a, np.array(b, np.int64)) if same and self.len_a[a].sum() == len(whole) else (none, none))
        return out

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For all texts together: n_a, n_b, hash of the groups, links as
        places in ``known``, and how many of them each text has."""
        coded = self.encode(texts)
        n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
        if not n_a.any():
            return n_a, n_b, [""] * len(texts), np.empty(0, np.int32), n_a
        a, b = (np.concatenate([c[k] for c in coded]).astype(np.int64) for k in (0, 1))
        # both sides describe the same bytes, so one running end serves all texts
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        near = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[near] == ends_a  # A tokens that end a group
        at_a, at_b = np.flatnonzero(last_a), near[last_a]
        last_b = np.zeros(len(b), bool)
        last_b[at_b] = True
        # groups in order, A before B: a token's place is its own number and
        # that of the other side's tokens before it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        merged = np.empty(len(a) + len(b), np.int64)
        merged[np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]] = 2 * a + last_a
        merged[np.arange(len(b)) + at_a[group_b] + 1] = self.first_b + 2 * b + last_b
        signs, cuts = self.signs[merged].tolist(), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        lines = ["".join(signs[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]
        digests = [hashlib.sha256(line.encode()).hexdigest() if line else "" for line in lines]
        links = np.searchsorted(self.known, a[at_a] * len(self.bytes_b) + b[at_b]).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), n_a)[at_a]
        return n_a, n_b, digests, links, np.bincount(owner, minlength=len(texts))


@lru_cache(maxsize=2)
def pair_of(file_a: bytes, file_b: bytes) -> Pair:
    """One set of tokenizers for each Python worker."""
    return Pair(file_a, file_b)


def load(folder: str = FOLDER, a: str = FILE_A, b: str = FILE_B) -> tuple[bytes, bytes]:
    """The vocabulary files, about 2 MB."""
    with open(os.path.join(folder, a), "rb") as fa, open(os.path.join(folder, b), "rb") as fb:
        return fa.read(), fb.read()


ALIGNED = "key binary, copies long, n_a long, n_b long, groups_sha256 string, link array<int>"
MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def align_texts(docs: DataFrame, files: tuple[bytes, bytes], text_col: str = "text") -> DataFrame:
    """ALIGNED: one row for each different text, with its multiplicity."""
    sent = docs.sparkSession.sparkContext.broadcast(files)  # two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*sent.value)
        for batch in batches:
            for start, texts in batches_of(batch.column(0), BATCH_BYTES):
                n_a, n_b, digests, links, sizes = pair.align([t.decode() for t in texts])
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.record_batch([
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), batch.column(1).slice(start, len(texts)),
                    pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(links))], names=names(ALIGNED))

    texts = docs.select(F.coalesce(ref(docs, text_col).cast("string"), F.lit("")).alias("text"))
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).mapInArrow(run, ALIGNED)


def links_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all links of a batch, and the row of each."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time: their links take about fifty bytes each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def pair_counts(aligned: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """(place, a, b, n, best): how many links of the corpus hold each pair of
    ids, and whether none of its B id's pairs has more."""
    size, known = len(pair_of(*files).bytes_b), pair_of(*files).known
    sent = aligned.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in slices(batches):
            link, row = links_of(batch.column(1))
            np.add.at(total, link, batch.column(0).to_numpy()[row])
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(sent.value[held]), pa.array(total[held])], names=["place", "code", "n"])

    counts = aligned.select("copies", "link").mapInArrow(run, "place long, code long, n long")
    summed = counts.groupBy("place", "code").agg(F.sum("n").alias("n"))
    summed = summed.select("place", F.expr(f"code div {size}").alias("a"), F.expr(f"code % {size}").alias("b"), "n")
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def measures(aligned: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """MEASURES: one row for each different text."""
    known = len(pair_of(*files).known)
    count, best = np.zeros(known, np.int64), np.zeros(known, np.int64)
    for r in pair_counts(aligned, files).collect():  # at most ``known`` rows
        count[r["place"]], best[r["place"]] = r["n"], r["best"]
    sent = aligned.sparkSession.sparkContext.broadcast((count, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in slices(batches):
            key, n_a, n_b, digest = (batch.column(i) for i in (0, 2, 3, 4))
            link, row = links_of(batch.column(5))
            sums = np.zeros((3, batch.num_rows), np.int64)
            for total, each in zip(sums, (np.ones(len(link), np.int64), best[link], count[link])):
                np.add.at(total, row, each)
            n = pa.array(sums[0])
            yield pa.record_batch([key, n_a, n_b, n, n, pa.array(sums[1]), pa.array(sums[2]), digest], names=names(MEASURES))

    return aligned.mapInArrow(run, MEASURES)


def alignment(docs: DataFrame, files: tuple[bytes, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id and MEASURES without key) of every row of ``docs``."""
    files = files or load()
    path = scratch_path(docs.sparkSession, "aligned")
    align_texts(docs, files, text_col).write.mode("overwrite").parquet(path)
    found = measures(docs.sparkSession.read.parquet(path), files)
    text = F.coalesce(ref(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(ref(docs, id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"))
    return rows.join(found, "key").drop("key")
