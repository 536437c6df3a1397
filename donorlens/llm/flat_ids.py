"""Token ids as flat binary files with 64-bit document offsets.

*Order.*  Documents are dealt over the tasks by ranges of doc_id (nulls first)
and sorted inside them, so the files, by number, hold all documents in
ascending doc_id order.  Text hash and row number break ties, so one
repeated doc_id does not land in one task.

*Files.*  Each task streams its documents into two files of the folder:
``part-N.ids``, the ids of all its documents one after the other as little-
endian unsigned integers (16 bits if the vocabulary allows it, else 32), and
``part-N.docs``, one pair of 64-bit integers a document: doc_id and the end of
its ids within the file.  Files appear under their name when they are whole, so
a task that is run again replaces them by equal ones.

*Bases.*  A file's first document number and first id number are prefix sums
over the counts of the files before it; the table of files (``files`` in the
folder) has them.  Ids number ``start`` to ``start + n_tokens`` of the corpus
are a document's; readers map the files into memory.

*Encoding.*  Texts are encoded by the tokenizers library.  No pre-token of
these vocabularies spans ASCII white space, so a text's ids are those of its
words, and equal words are encoded once while a task remembers them.  Words of
printable ASCII and Latin-1 letters go to the library's BPE model directly,
pre-token by pre-token, all others through its whole pipeline.

The folder must be one that the driver and all executors mount (files are
mapped into memory).  Defined results: a null or empty text has only the end
id; documents with a null doc_id come first; rows that repeat a doc_id are
documents of their own, ordered by the hash of their text; very long texts are
encoded in pieces of about a megabyte; an empty table gives an empty table of
files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from donorlens.llm.common import new_folder, small_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
REMEMBERED = 800_000  # words that a worker keeps at least
PIECE, GROUP = 1 << 20, 4 << 20  # bytes: of one cut of a long text; of texts looked up together
FILES = "file_no int, name string, width int, n_docs long, n_null long, n_ids long"
_LOADED: dict = {}
_GAP = re.compile(rb"\s")

# The vocabulary's own pre-token rule for plain words: printable ASCII and the
# letters of Latin-1, which neither composing nor lower-casing changes in number.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in stay)}


class _Recent:
    """The ids of words met lately: of the last ``REMEMBERED`` and, until they are
    needed again, of as many before those.  Frequent words stay, rare ones go."""

    def __init__(self):
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def known(self, wanted: set[bytes]) -> tuple[dict[bytes, bytes | None], list[bytes]]:
        """The ids of ``wanted`` (None: not known), and those not known."""
        if len(self.now) > REMEMBERED:
            self.before, self.now = self.now, {}
        now, before, missing = self.now.get, self.before.get, []
        found = {word: now(word) for word in wanted}
        for word in [w for w, ids in found.items() if ids is None]:
            if (ids := before(word)) is None:
                missing.append(word)
            else:
                found[word] = self.now[word] = ids
        return found, missing


class WordEncoder:
    """Encodes texts word by word; ``ids`` are little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(vocabulary)
        self.model = Tokenizer(self.library.model)  # the same merges, for pre-tokens in byte letters
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.letters = _byte_letters()
        self.words = _Recent()

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _encoded_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, by the model alone in one call."""
        order = list(pieces)
        if not order:
            return {}
        text = " ".join(order)
        if not text.isascii():
            text = " ".join([p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in order])
        found = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends_word[found]) + 1
        if len(ends) != len(order):  # a vocabulary without an end for every word
            tracked = self.model.encode(text, add_special_tokens=False)
            ends = np.searchsorted(np.asarray(tracked.word_ids, np.int64), np.arange(len(order)), "right")
        ids, ends = found.tobytes(), (ends * self.width).tolist()
        return {piece: ids[a:b] for piece, a, b in zip(order, [0, *ends[:-1]], ends, strict=True)}

    def _learned(self, words: list[bytes]) -> dict[bytes, bytes]:
        letters, texts, mixed, pieces, rest = [], [], [], [], []
        for word in words:
            text = word.decode()
            if not (text.isprintable() if text.isascii() else _PLAIN.fullmatch(text)):
                rest.append(word)
            elif text.isalpha():
                letters.append(word)
                texts.append(text.lower())
            elif "<|" not in text:  # special tokens are the pipeline's
                mixed.append(word)
                pieces.append(_PRETOKEN.findall(text.lower()))
            else:
                rest.append(word)
        ids = self._encoded_pieces(set(texts).union(*pieces)).__getitem__
        out = dict(zip(letters, map(ids, texts), strict=True))
        out.update(zip(mixed, [b"".join(map(ids, p)) for p in pieces], strict=True))
        if rest:
            found = self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            out.update(zip(rest, [self.packed(f.ids) for f in found], strict=True))
        return out

    def _pieces_of(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(row, UTF-8) of every text, long ones in pieces cut at white space."""
        for row, text in enumerate(texts):
            data, at = (text or "").encode(), 0
            while len(data) - at > PIECE and (gap := _GAP.search(data, at + PIECE)):
                yield row, data[at:gap.end()]
                at = gap.end()
            yield row, data[at:]

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(row, ids), in the order of the texts; a long text has several, every one at least one."""
        group, size = [], 0
        for row, data in self._pieces_of(texts):
            group.append((row, data.split()))
            size += len(data)
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, bytes]]:
        known, missing = self.words.known(set().union(*[words for _, words in group]))
        if missing:
            new = self._learned(missing)
            self.words.now.update(new)
            known.update(new)
        for row, words in group:
            yield row, b"".join(map(known.__getitem__, words))


def _encoder(vocabulary: str) -> WordEncoder:
    """One encoder a Python worker."""
    if vocabulary not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[vocabulary] = WordEncoder(vocabulary)
    return _LOADED[vocabulary]


def local_path(folder: str) -> str:
    """The path of a mounted folder; other kinds of storage cannot be mapped into memory."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"flat files need a folder that all executors mount, not {folder}")
    return parts.path


def _write_batches(folder: str, vocabulary: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(vocabulary), TaskContext.get().partitionId()
        end = encoder.packed([end_id])
        name, own = f"part-{number:06d}", f"{folder}/.{uuid.uuid4().hex}"
        n_docs = n_null = n_ids = 0
        with open(f"{own}.ids", "wb") as ids_file, open(f"{own}.docs", "wb") as docs_file:
            for batch in small_batches(batches, 1024):
                doc_ids, sizes = batch.column("doc_id").to_pylist(), [0] * batch.num_rows
                last = 0
                for row, ids in encoder.encoded(batch.column("text").to_pylist()):
                    if row != last:
                        sizes[last] += ids_file.write(end)
                        last = row
                    sizes[row] += ids_file.write(ids)
                sizes[last] += ids_file.write(end)
                ends = n_ids + np.cumsum(sizes) // encoder.width
                docs_file.write(np.column_stack((np.array([d or 0 for d in doc_ids], "<i8"), ends.astype("<i8"))).tobytes())
                n_ids = int(ends[-1])
                n_docs += batch.num_rows
                n_null += sum(d is None for d in doc_ids)
        for kind in ("ids", "docs"):
            if n_docs:
                os.replace(f"{own}.{kind}", f"{folder}/{name}.{kind}")
            else:
                os.remove(f"{own}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([number], pa.int32()), "name": [name], "width": pa.array([encoder.width], pa.int32()),
                "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]})

    return run


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the flat files of (doc_id, text) and their table of files; returns the folder.

    ``tokenizer`` is the path of a word vocabulary of the tokenizers library;
    ``folder`` a new folder under the shared checkpoint folder if not given."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    with open(tokenizer or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = f.read()  # a few MB, travels with the tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    files = (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
             .mapInArrow(_write_batches(path, vocabulary, end_id), FILES))
    files.write.parquet(f"{folder}/counts")
    counts = docs.sparkSession.read.schema(files.schema).parquet(f"{folder}/counts")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = counts.select("*", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"))
    based.write.parquet(f"{folder}/files")
    return folder


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files: counts, and the bases ``first_doc`` and ``first_id``."""
    return spark.read.schema(f"{FILES}, first_doc long, first_id long").parquet(f"{folder}/files")


def _mapped(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, dtype=kind, mode="r")


def _read_batches(folder: str, with_ids: bool, rows: int = 4096) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                docs = _mapped(f"{folder}/{f['name']}.docs", "<i8").reshape(-1, 2)
                ids = _mapped(f"{folder}/{f['name']}.ids", f"<u{f['width']}")
                if (len(docs), len(ids)) != (f["n_docs"], f["n_ids"]):
                    raise ValueError(f"{f['name']} is damaged")
                for a in range(0, len(docs), rows):
                    part = docs[a:a + rows]
                    ends = np.array(part[:, 1])
                    begins = np.concatenate(([docs[a - 1, 1] if a else 0], ends[:-1]))
                    wide = [ids[x:y].astype("<u4") for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                    cols = {"doc_id": pa.array(np.array(part[:, 0]), mask=np.arange(a, a + len(part)) < f["n_null"]), "start": begins + f["first_id"],
                            "n_tokens": ends - begins, "ids_crc32": np.array([zlib.crc32(w) for w in wide], np.int64)}
                    if with_ids:
                        cols["ids"] = pa.array([w.tobytes() for w in wide], pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (with the end
    id), ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files(spark, folder).repartition("file_no").mapInArrow(_read_batches(local_path(folder), with_ids), kind)


class FlatIds:
    """Random access for training loops: ids by global place, documents by global number."""

    def __init__(self, folder: str):
        self.folder = local_path(folder)
        self.files = sorted(pq.read_table(f"{self.folder}/files").to_pylist(), key=lambda f: f["file_no"])
        self.first_ids = np.array([f["first_id"] for f in self.files], np.int64)
        self.first_docs = np.array([f["first_doc"] for f in self.files], np.int64)

    def __len__(self) -> int:
        return self.files[-1]["first_id"] + self.files[-1]["n_ids"] if self.files else 0

    def _ids_of(self, f: dict) -> np.ndarray:
        return _mapped(f"{self.folder}/{f['name']}.ids", f"<u{f['width']}")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the corpus, over file borders."""
        stop, parts = min(stop, len(self)), []
        while start < stop:
            f = self.files[int(np.searchsorted(self.first_ids, start, "right")) - 1]
            part = self._ids_of(f)[start - f["first_id"]: stop - f["first_id"]]
            parts.append(part.astype("<u4"))
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, number: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of the document of that number in the order of the files."""
        f = self.files[int(np.searchsorted(self.first_docs, number, "right")) - 1]
        k = number - f["first_doc"]
        docs = _mapped(f"{self.folder}/{f['name']}.docs", "<i8").reshape(-1, 2)
        begin = int(docs[k - 1, 1]) if k else 0
        return None if k < f["n_null"] else int(docs[k, 0]), self._ids_of(f)[begin:int(docs[k, 1])].astype("<u4")
