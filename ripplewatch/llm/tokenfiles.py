"""Token-id files: flat unsigned integers in document order, with 64-bit document offsets, read by memory mapping.

Documents are dealt into contiguous ranges of doc_id. The task that holds a range encodes it and writes three flat
files: ``.bin`` (token ids, 2 bytes each when the vocabulary fits, else 4), ``.off`` (n + 1 signed 64-bit offsets, in
tokens from the start of the file) and ``.doc`` (n doc_ids, 64-bit). The manifest has one row per file; the running
sum of its token counts gives each file the place of its first token in the corpus, so nothing renumbers tokens.

File names carry the task attempt, and only the manifest says which files count: a task that is lost and run again
leaves files that nobody reads.
"""

import os
import re
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import gather
from ripplewatch.llm.common import ROWS_PER_BUCKET, documents, ordered_buckets, texts_of

NULL_ID = -(2**63)
KNOWN_WORDS = 700_000
_tokenizers: dict = {}


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece between spaces once.

    Byte-level pre-tokenizers never join characters across a space that follows a visible character: the space opens
    the next pre-token. So the ids of a text are those of its pieces, each with its space in front, in order. A text in
    which white space meets white space is given to the library whole. What is known is only a cache, emptied when
    it is full.

    Added tokens such as ``<|endoftext|>`` hold no space, so they stay inside one piece. With ``specials_as_text`` they
    are spelled like any other text; without it they get their own ids, as in the library's plain call.
    """

    def __init__(self, path: str, *, specials_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.lengths = np.zeros(self.vocabulary, np.int64)  # in bytes; the byte-level alphabet has a character for each
        for token, at in self.tokenizer.get_vocab().items():
            self.lengths[at] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.fresh: list[str] = []
        self.first = _Numbers(self.fresh, "")  # pieces that open a text, without a space
        self.later = _Numbers(self.fresh, " ")
        self.flat, self.low, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        flat, low, size = [self.flat], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        spaced = np.array([p.startswith(" ") for p in pieces], bool)
        held = len(self.flat)
        for opens in (True, False):
            at = np.flatnonzero(spaced == opens)
            for some in np.split(at, range(1000, len(at), 1000)):
                own = [pieces[k] for k in some.tolist()]
                # Pieces that bring their space follow each other as in a text; the others are kept apart.
                shown = "".join(own) if opens else own
                made = self.tokenizer.encode_batch_fast([shown], is_pretokenized=not opens, add_special_tokens=False)[0]
                flat.append(np.array(made.ids, np.uint32))
                # Tokens spell the bytes of the pieces without gaps, so their lengths tell where each piece ends.
                ends = np.cumsum([len(p.encode("utf-8")) for p in own])
                upto = np.searchsorted(np.cumsum(self.lengths[flat[-1]]), ends, side="right")
                size[some] = np.diff(upto, prepend=0)
                low[some] = held + upto - size[some]
                held += len(flat[-1])
        self.flat = np.concatenate(flat)
        self.low, self.size = np.r_[self.low, low], np.r_[self.size, size]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.fresh) > KNOWN_WORDS:
            self._forget()
        known, first, later, rows, sizes, whole = len(self.fresh), self.first, self.later.__getitem__, [], [], {}
        for n, text in enumerate(texts):
            if _MEETS.search(text):
                made = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
                whole[n] = np.array(made.ids, np.uint32)
                sizes.append(0)
                continue
            pieces = text.split(" ")
            rows.append(first[pieces[0]])
            rows.extend(map(later, pieces[1:]))
            sizes.append(len(pieces))
        if len(self.fresh) > known:
            self._learn(self.fresh[known:])
        at = np.array(rows, np.int64)
        low, lengths = self.low[at], self.size[at]
        upto = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(sizes)]]
        ids = gather(self.flat, low, lengths)
        return [whole[n] if n in whole else ids[upto[n] : upto[n + 1]] for n in range(len(texts))]


class _Numbers(dict):
    """Numbers of pieces in the order in which they were first met; ``fresh`` lists them as they are spelled."""

    def __init__(self, fresh: list[str], space: str):
        self.fresh, self.space = fresh, space

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self.fresh)
        self.fresh.append(self.space + piece)
        return at


#: White space beside a space, or a text that begins or ends with white space.
_MEETS = re.compile(r"(?:\A| )(?:\Z|\s)|\s(?: |\Z)")


def _encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path, specials_as_text=False)
    return _tokenizers[path]


class _RangeFile:
    """The three files of one range of documents while they are written."""

    def __init__(self, folder: str, bucket: int, dtype: str):
        task = TaskContext.get()
        attempt = task.taskAttemptId() if task else 0
        self.bucket, self.dtype, self.total, self.count, self.low = bucket, dtype, 0, 0, None
        self.uri = f"{folder}/tokens-{bucket:08d}-{attempt}"
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        stem = f"{path}/tokens-{bucket:08d}-{attempt}"
        self.bin, self.off, self.doc = (fs.open_output_stream(f"{stem}.{kind}") for kind in ("bin", "off", "doc"))
        self.off.write(np.zeros(1, "<i8").tobytes())

    def add(self, keys: list, rows: list[np.ndarray]) -> None:
        self.bin.write(np.concatenate(rows).astype(self.dtype).tobytes())
        upto = self.total + np.cumsum([len(r) for r in rows])
        self.off.write(upto.astype("<i8").tobytes())
        self.doc.write(np.array([NULL_ID if k is None else k for k in keys], "<i8").tobytes())
        self.total, self.count = int(upto[-1]), self.count + len(keys)

    def close(self) -> tuple:
        for out in (self.bin, self.off, self.doc):
            out.close()
        return self.bucket, self.uri, self.dtype, self.count, self.total


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, *, rows_per_file: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Write the files and return the manifest (bucket, uri, dtype, n_docs, n_tokens, base), stored beside them.

    Ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: a text that spells an added
    token holds that token's id.
    Documents go in ascending doc_id, null ids first; rows with equal ids are ordered by text. A null or empty text
    is a document holding only ``end_id``. An empty table writes no files and an empty manifest.
    """
    spark = docs.sparkSession
    rows = ordered_buckets(documents(docs), "doc_id", rows_per_file)
    rows = rows.repartition("_bucket").sortWithinPartitions("_bucket", "doc_id", "text")
    names = ["bucket", "uri", "dtype", "n_docs", "n_tokens"]

    def write(batches):
        out, done = None, []
        for batch in batches:
            encoder = _encoder(tokenizer_path)
            dtype = "<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
            keys, texts, buckets = batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_numpy()
            start = 0
            while start < len(keys):
                # A few hundred documents of one range at a time.
                stop = min(start + 256, int(np.searchsorted(buckets, buckets[start], side="right")))
                if out is None or out.bucket != buckets[start]:
                    if out:
                        done.append(out.close())
                    out = _RangeFile(folder, int(buckets[start]), dtype)
                coded = encoder.encode(texts[start:stop])
                out.add(keys[start:stop], [np.append(ids, np.uint32(end_id)) for ids in coded])
                start = stop
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=names), preserve_index=False)

    manifest = rows.mapInArrow(write, "bucket long, uri string, dtype string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    stored = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return stored.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _array(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped where the folder is mounted, else read."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return np.memmap(at.path, dtype, "r") if os.path.getsize(at.path) else np.zeros(0, dtype)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_tokens(manifest: DataFrame, *, digests: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens and ``ids``, or ``ids_crc32`` in their place.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over the ids as little-endian 32-bit integers.
    """
    last = "ids_crc32 long" if digests else "ids array<int>"

    def read(frames):
        for frame in frames:
            for file in frame.itertuples():
                offsets, keys = _array(f"{file.uri}.off", "<i8"), _array(f"{file.uri}.doc", "<i8")
                tokens = _array(f"{file.uri}.bin", file.dtype)
                for low in range(0, len(keys), 512):
                    cut = offsets[low : low + 513]
                    rows = [tokens[a:b].astype("<u4") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    own = pd.Series(keys[low : low + 512], dtype="Int64").replace(NULL_ID, pd.NA)
                    shown = [zlib.crc32(r.tobytes()) for r in rows] if digests else [r.astype(np.int32) for r in rows]
                    yield pd.DataFrame(
                        {"doc_id": own, "start": file.base + cut[:-1], "n_tokens": np.diff(cut), last.split()[0]: shown}
                    )

    # A fixed number of tasks: the rows are tiny, the files behind them are not.
    tasks = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    files = manifest.select("bucket", "uri", "dtype", "base").repartition(tasks, "bucket")
    return files.mapInPandas(read, f"doc_id long, start long, n_tokens long, {last}")
