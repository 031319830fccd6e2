"""Token ids in ORC files: range-sorted by document id, with row indexes and Bloom filters.

Documents are dealt by ranges of doc_id, so each file holds one range in ascending order and the
stripe and row-group statistics of doc_id let a reader skip all others; Bloom filters settle point
look-ups. Ids are plain integer columns, which ORC run-length encodes. Reading is parallel by
stripe. A document's start is a two-level running sum: within its file, and over the files.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .token_counts import byte_symbols

_GAP = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?=\s|$)")
#: Letters or numbers, and marks after them: the pattern always cuts between the two.
_MARKED = re.compile(r"([^\W_]+)([!-&(-/:-@\[-`{-~]+)")
#: Kinds of characters to the splitting pattern; those of OPEN are left to the library.
OPEN, LETTER, NUMBER, OTHER, BREAK, SPACE = range(6)
#: Bytes that UTF-8 never has; one of them keeps parts apart that the library merges in one run.
NEVER = [0xC0, 0xC1, *range(0xF5, 0x100)]
#: Bytes of texts that are encoded together.
CHUNK = 8 << 20


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point up to U+FFFF; only characters that have kept their category since Unicode 3.2 have one."""
    kind_of = {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER, "M": OTHER}
    kinds = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        now, then = unicodedata.category(chr(i))[0], unicodedata.ucd_3_2_0.category(chr(i))[0]
        kinds[i] = kind_of.get(now, OPEN) if now == then else OPEN
    kinds[ord("'")] = OPEN
    kinds[ord("\t") : ord("\r") + 1] = BREAK
    kinds[ord(" ")] = SPACE
    return kinds


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered by space-separated piece.

    A byte-level splitting pattern always cuts before a space that precedes a visible character,
    so the ids of a text are those of its pieces one after the other. New pieces are encoded
    together, as one text, and told apart by the tokens that begin with a space.

    Columns of texts are split, and their distinct pieces found, by Arrow. Pieces of letters, numbers
    and marks are cut as the pattern does; the library merges the new parts in long runs, with a byte
    between them that takes part in no merge. Other pieces, and texts with a space before or after
    other white space, go the plainer way.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        # The same model without the pattern and the special strings.
        self.merger, self.special = Tokenizer(self.library.model), [t.content for t in self.library.get_added_tokens_decoder().values()]
        alphabet, vocab = byte_symbols(), self.library.get_vocab()
        merged = set().union(*(t for t in vocab if len(t) > 1 and t not in self.special))
        self.symbols = np.array([ord(c) for c in alphabet], "<u4")
        self.between = next((b for b in NEVER if alphabet[b] in vocab and alphabet[b] not in merged), None)
        self.nothing = (pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))
        self.parts, self.ids, self.offsets = self.nothing

    def _one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces with a space before each; a word with marks after it is the word, then the marks."""
        found = {p: self._one(" " + p) for p in new if not p or p[-1].isspace() or " " in p}
        marked = {p: m.groups() for p in new if p and not p[-1].isalnum() and (m := _MARKED.fullmatch(p))}
        for marks in {m for _, m in marked.values()} - self.marks.keys():
            self.marks[marks] = self._one(marks)
        plain = list({marked[p][0] if p in marked else p for p in new if p not in found}.difference(self.known))
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), len(ids) * 4]
            raw = ids.tobytes()
            found.update(zip(some, (raw[i:j] for i, j in zip(cuts, cuts[1:])), strict=True))
        for p, (word, marks) in marked.items():
            found[p] = (found.get(word) or self.known[word]) + self.marks[marks]
        return found

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with ``end`` after each."""
        split = [(_GAP.split(t) if _ODD.search(t) else t.split(" ")) for t in texts]
        found = [list(map(self.known.get, s)) for s in split]
        new: set[str] = set()
        for s, ids in zip(split, found):
            ids[0] = self._one(s[0])
            if None in ids:
                new.update([p for p, x in zip(s, ids) if x is None])
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known = {}
            self.known.update(fresh := self._learn(list(new)))
            found = [[fresh[p] if x is None else x for p, x in zip(s, ids)] if None in ids else ids for s, ids in zip(split, found)]
        return [b"".join(ids) + end for ids in found]

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their offsets of parts that the pattern does not cut."""
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        chars = self.symbols[np.insert(raw, offsets[:-1] - offsets[0], self.between)]
        begins = offsets[:-1] - offsets[0] + np.arange(len(parts))
        # Runs of about 1 KB, handed over by 64 KB, so that few results are held at once.
        begins = begins[np.unique(begins >> 10, return_index=True)[1]]
        runs = [chars[i:j].tobytes().decode("utf-32-le") for i, j in zip(begins, [*begins[1:], len(chars)])]
        groups = np.unique(begins >> 16, return_index=True)[1]
        found = [np.zeros(0, np.int32)]
        for i, j in zip(groups, [*groups[1:], len(runs)]):
            found += [np.array(e.ids, np.int32) for e in self.merger.encode_batch_fast(runs[i:j], add_special_tokens=False)]
        ids = np.concatenate(found)
        first = np.flatnonzero(ids == (mark := self.merger.token_to_id(chr(self.symbols[self.between]))))
        return ids[ids != mark], np.append(first - np.arange(len(first)), len(ids) - len(first))

    def _cut(self, words: pa.Array, bare: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of pieces with a space before each, which is a part of its own for the last ``bare`` ones.

        Also where pieces begin among the parts, which are open, which begin and which end with a break.
        """
        text = b" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
        raw, points = np.frombuffer(text, np.uint8), np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
        kinds = np.where(points < 1 << 16, _kinds()[points & 0xFFFF], OPEN)
        begins = np.flatnonzero(kinds == SPACE)
        here, before, after = kinds[1:], kinds[:-1], np.append(kinds[2:], SPACE)
        cut = np.ones(len(kinds), bool)
        cut[1:] = (here == SPACE) | ((here != before) & (before != SPACE)) | ((here == BREAK) & (before == BREAK) & (after != BREAK) & (after != SPACE))
        inner = begins[len(words) - bare :] + 1
        cut[inner[inner < len(cut)]] = True
        cuts = np.flatnonzero(cut)
        place = cuts if len(points) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)[cuts]
        parts = pa.StringArray.from_buffers(len(place), pa.py_buffer(np.append(place, len(raw)).astype(np.int32)), pa.py_buffer(text))
        open_ = np.zeros(len(words), bool)
        open_[np.searchsorted(begins, np.flatnonzero(kinds == OPEN), "right") - 1] = True
        for special in self.special:
            open_ |= pc.match_substring(words, special).to_numpy(zero_copy_only=False)
        return parts, np.append(np.searchsorted(cuts, begins), len(cuts)), open_, np.append(kinds, SPACE)[begins + 1] == BREAK, kinds[np.append(begins[1:], len(kinds)) - 1] == BREAK

    def _pieces(self, words: pa.Array, bare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of pieces, where those of each begin and how many they are; which begin and which end with white space."""
        parts, at, open_, opens, closes = self._cut(words, bare)
        coded = pc.dictionary_encode(pa.concat_arrays([self.parts, parts]))
        known, codes = coded.dictionary, coded.indices.to_numpy()[len(self.parts) :]
        fresh, offsets = self._merged(known.slice(len(self.parts)))
        ids, offsets = np.concatenate([self.ids, fresh]), np.append(self.offsets, len(self.ids) + offsets[1:])
        if len(known) <= self.limit:
            self.parts, self.ids, self.offsets = known, ids, offsets
        else:
            self.parts, self.ids, self.offsets = self.nothing
        sizes = np.diff(offsets)[codes]
        sizes[codes == pc.index(known, " ").as_py()] = 0
        flat, ends = ids[_runs(offsets[codes], sizes)], np.append(0, np.cumsum(sizes))[at]
        begin, size = ends[:-1].copy(), np.diff(ends)
        some = np.flatnonzero(open_)
        if len(some):
            texts = words.take(pa.array(some)).to_pylist()
            known = self.known
            new = {p for i, p in zip(some, texts) if i < len(words) - bare} - known.keys()
            if len(known) + len(new) > self.limit:
                self.known = {}
            self.known.update(fresh := self._learn(list(new)))
            found = [np.frombuffer(self._one(p) if i >= len(words) - bare else fresh.get(p) or known[p], "<i4") for i, p in zip(some, texts)]
            size[some] = [len(x) for x in found]
            begin[some] = len(flat) + np.cumsum(size[some]) - size[some]
            flat = np.concatenate([flat, *found])
            opens[some] |= [p[:1].isspace() for p in texts]
            closes[some] |= [p[-1:].isspace() for p in texts]
        return flat, begin, size, opens, closes

    def encode_column(self, texts: pa.Array, end_id: int, rows: int = 512) -> Iterator[pa.ListArray]:
        """Ids of each text of a string column without nulls, with ``end_id`` after each, for so many rows at a time."""
        if self.between is None:
            for i in range(0, len(texts), rows):
                yield pa.array([[*np.frombuffer(x, "<i4"), end_id] for x in self.encode(texts.slice(i, rows).to_pylist(), b"")], pa.list_(pa.int32()))
        if self.between is None or not len(texts):
            return
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        words, firsts = pc.dictionary_encode(split.flatten()), pc.dictionary_encode(split.flatten().take(pa.array(offsets[:-1])))
        codes, count = words.indices.to_numpy().copy(), len(words.dictionary) + len(firsts.dictionary)
        flat, begin, size, opens, closes = self._pieces(pa.concat_arrays([words.dictionary, firsts.dictionary]), len(firsts.dictionary))
        blank, odd = codes == pc.index(words.dictionary, "").as_py(), opens[codes]
        blank[offsets[:-1]] = odd[offsets[:-1]] = False
        codes[offsets[:-1]] = firsts.indices.to_numpy() + len(words.dictionary)
        # Blank pieces are further spaces: a part of their own, unless they meet other white space.
        run = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
        spaces, kind = np.unique(np.flatnonzero(blank & ~np.append(blank[1:], False)) - run + 1, return_inverse=True)
        odd[run] |= closes[codes[run - 1]]
        whole = np.flatnonzero(np.logical_or.reduceat(odd, offsets[:-1]))
        own = [np.frombuffer(x, "<i4") for x in [*(self._one(" " * int(n)) for n in spaces), *self.encode(texts.take(pa.array(whole)).to_pylist(), b"")]]
        # After the pieces: the end, nothing, runs of spaces, and the texts that are encoded by themselves.
        more = np.array([1, 0, *map(len, own)])
        begin, size = np.append(begin, len(flat) + np.cumsum(more) - more), np.append(size, more)
        flat = np.concatenate([flat, np.array([end_id], np.int32), *own])
        codes[blank] = count + 1
        codes[run] = count + 2 + kind
        codes[_runs(offsets[whole], offsets[whole + 1] - offsets[whole])] = count + 1
        codes[offsets[whole]] = count + 2 + len(spaces) + np.arange(len(whole))
        for i in range(0, len(texts), rows):
            at = offsets[i : i + rows + 1]
            some = np.insert(codes[at[0] : at[-1]], at[1:] - at[0], count)
            lengths = size[some]
            ends = np.append(0, np.cumsum(lengths))[at - at[0] + np.arange(len(at))]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[_runs(begin[some], lengths)], pa.int32()))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0, parts: int | None = None, stripe_mb: int = 16) -> None:
    """Encode ``docs(doc_id, text)`` and write ORC rows ``doc_id, seq, ids`` in ascending doc_id.

    A null text is empty and yields the end id alone; null ids come first; rows that repeat a
    doc_id follow each other, ordered by a hash of their text. ``seq`` counts the rows of a file.
    """
    parts = parts or max(8, docs.select("text").rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = _encoder(tokenizer), 0
        for whole in batches:
            texts = pc.fill_null(whole.column(1), "")
            below = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(below, (below[at - 1] if at else 0) + CHUNK, "right")))
                for ids in encoder.encode_column(texts.slice(at, to - at), end_id):
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(ids)), pa.array(np.arange(seq, seq + len(ids)), pa.int64()), ids], ["doc_id", "seq", "ids"])
                    seq, at = seq + len(ids), at + len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    coded = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, seq long, ids array<int>")
    coded.write.option("compression", "lz4").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_mb << 20)).orc(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, seq, ids, file`` of files that ``write_token_files`` wrote; filters on doc_id prune."""
    return spark.read.schema("doc_id long, seq long, ids array<int>").orc(path).select("*", F.col("_metadata.file_path").alias("file"))


def token_index(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows that ``read_token_files`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, ends = memoryview(np.ascontiguousarray(ids.values, "<i4")), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "seq", "file", "n_tokens", "ids_crc32"])

    found = rows.select("doc_id", "seq", "file", "ids").mapInArrow(run, "doc_id long, seq long, file string, n_tokens long, ids_crc32 long")
    found = scratch.table(found, "index")
    of_file = Window.partitionBy("file").orderBy("seq")
    files = found.groupBy("file").agg(F.min(F.struct("doc_id")).alias("least"), F.sum("n_tokens").alias("n"))
    found = found.withColumn("inside", F.sum("n_tokens").over(of_file) - F.col("n_tokens"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("least", "file")) - F.col("n")).alias("before"))
    return found.join(files, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all of ``docs`` as token files, read them back and index them."""
    scratch = Scratch(spark, "token-files")
    out = scratch.path("orc")
    write_token_files(docs, tokenizer, out, end_id)
    return token_index(read_token_files(spark, out), scratch)
