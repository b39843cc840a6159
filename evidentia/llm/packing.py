"""Packing by power-of-two decomposition.

A document of L tokens is cut into as many pieces of ``max_len`` tokens as fit, and the rest into the
powers of two of its binary form, largest first. A piece is a training sequence by itself: its length is a
power of two, so it needs no padding, and no sequence crosses documents. Equal lengths share a bucket;
``write_buckets`` writes one folder a bucket, from which a trainer draws batches of one length.

Tokens come from a public tokenizer file. That tokenizer splits a text into pieces before it merges bytes, so
in texts of plain characters each distinct piece is encoded once and looked up afterwards; the table of known
pieces is bounded in entries and in the length of each, and keeps what the texts at hand use when it is full; long texts are read in parts. Words with other characters
are encoded as they are.

Defined cases: a null text is the empty text and gives one piece, the end token. Repeated rows are packed
each for itself. An empty table gives no rows. A null ``doc_id`` stays null. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm._shared import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"

#: Beyond white space, printable ASCII and Latin-1 letters: only of those are case folding and normal form plain.
_OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]").search
#: The tokenizer file's own split pattern, narrowed to those characters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall
_SPACE = re.compile("[\\x09-\\x0d ]+").split
_SPACES = re.compile("[\\x09-\\x0d ]").search
_END_OF_WORD = "</w>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by the pieces into which the tokenizer splits a text.

    Pieces of up to ``SHORT`` characters are kept, ``limit`` at most, so the table has a bound in bytes; a text is read
    in parts of about ``PART`` characters, cut at white space.
    """

    SHORT, PART = 48, 1 << 20

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(_END_OF_WORD)]] = True
        self.limit, self.known = limit, {}

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces as one text; each ends with the only token of it that ends a word."""
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise AssertionError("a piece has not exactly one end")
            data, begin = ids.tobytes(), 0
            for piece, end in zip(part, (cuts * 4).tolist(), strict=True):
                self.known[piece] = data[begin:end]
                begin = end

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Keys of a text; one that begins with a space is a word with other characters, to encode as it is."""
        if not _OTHER(text):
            return _PIECES(text.lower())
        return [p for w in _SPACE(text) if w for p in ([" " + w] if _OTHER(w) else _PIECES(w.lower()))]

    def _join(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of keys."""
        here = {p for pieces in split for p in pieces}
        missing = here.difference(self.known)
        if len(self.known) + len(missing) > self.limit:
            self.known = {p: self.known[p] for p in here.difference(missing)}  # what is frequent stands here, too
        self._learn([p for p in missing if p[0] != " "])
        self.known.update((p, self._whole(p)) for p in missing if p[0] == " ")
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for p in missing:
            if len(p) > self.SHORT:
                del self.known[p]
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of a text between white space."""
        begin = 0
        while len(text) - begin > self.PART:
            m = _SPACES(text, begin + self.PART)
            if not m:
                break
            yield text[begin : m.start()]
            begin = m.start()
        yield text[begin:]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        plain = [t or "" for t in texts]
        near = iter(self._join([self._pieces(t) for t in plain if len(t) <= self.PART and "<|" not in t]))
        for text in plain:
            if "<|" in text:
                yield self._whole(text)
            elif len(text) <= self.PART:
                yield next(near)
            else:
                yield b"".join(self._join([self._pieces(part)])[0] for part in self._parts(text))


#: The table of a worker process, kept for its next task.
_WARM: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(path: str, known: int, warm: bool) -> PieceEncoder:
    if not warm:
        return PieceEncoder(path, known)
    if (path, known) not in _WARM:
        _WARM.clear()  # one table a process
        _WARM[path, known] = PieceEncoder(path, known)
    return _WARM[path, known]


def lengths(tokens: int, max_len: int = 4096) -> list[int]:
    """The pieces of a document of so many tokens."""
    whole, rest = divmod(tokens, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str | None = None, max_len: int = 4096, end_id: int = 2, with_ids: bool = False, known: int = 800_000, warm: bool = True
) -> DataFrame:
    """One row a piece; ``with_ids`` adds the ids themselves. ``max_len`` must be a power of two. known: how many pieces of words a task remembers.

    warm: a worker process keeps its table of pieces, and the tokenizer, for its next task, which costs their memory afterwards.

    ``sequence_id`` holds the number of the scan's partition and a count within it, so a task that runs
    anew gives the same numbers and no shuffle is needed.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, count = _encoder(path, known, warm), TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, "text", 2_000_000):
            out, own, kept = [[] for _ in range(5)], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                data = memoryview(ids + end)
                tokens, start = len(data) // 4, 0
                for n in lengths(tokens, max_len):
                    piece = data[4 * start : 4 * (start + n)]
                    for col, value in zip(out, (doc_id, start, n, zlib.crc32(piece), tokens), strict=True):
                        col.append(value)
                    if with_ids:
                        kept.append(piece)
                    own.append(n.bit_length() - 1)
                    start += n
            rows = len(own)
            cols = [pa.array(c, pa.int64()) for c in out] + [
                pa.array(np.arange(count, count + rows)), pa.array(np.zeros(rows, np.int64)), pa.array(own, pa.int32())
            ]
            count += rows
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                flat = np.frombuffer(b"".join(kept), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def write_buckets(docs: DataFrame, path: str, **options) -> None:
    """Write the sequences with their ids, one folder for each power of two."""
    pack(docs, with_ids=True, **options).write.partitionBy("bucket").parquet(path)
