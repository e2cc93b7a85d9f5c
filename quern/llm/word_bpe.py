"""BPE encoding and decoding over a table of distinct words.

A word is what the tokenizer's own splitting leaves: texts are normalised and
cut in Spark tasks, each distinct word of all texts is encoded once, and the ids
come back to the texts by position.

1. ``word_table`` counts the words of all texts and encodes each distinct one.
2. The most frequent words, up to ``FREQUENT_BYTES`` of table, go to every task.
   A task replaces them by their ids; at each other word it leaves a gap.
3. The words in the gaps join the table as rows (row, gap, word), and their ids
   are put in at those positions.  By its count such a word stands in few gaps,
   so no key of that join is hot.  Texts travel once, as packed ids; their key is
   a digest of the text, so a task that runs again finds the same ones.
   Where the tasks' table holds every word that occurs twice or more, a word that
   it lacks is the only one of its kind: it is encoded where it stands, and step 3
   has no rows.

The table in the tasks holds hashes of words, sorted, and their ids.  All words of
the texts are known, so a hash that two of them share is left out of it.

Decoding joins ids with the pieces of the vocabulary, whose size the tokenizer
fixes, and puts the pieces together by position.

The tokenizer is a file of the tokenizers library with a BPE model over bytes, a
word-end suffix, and neither unknown token nor decoder; other models are refused.
The splitting is the file's own; the merges are made here.

Null and empty texts have no ids; null ids decode to an empty text.  Repeated
rows are encoded like any others, long words in time n log n, tables without
rows give none, and input columns keep their names: only the column named by
``out`` is replaced where it exists.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.registry import query
from quern.llm.shared import read_table, stored

#: White space in the splitting patterns of these files.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Bytes of the table of frequent words in each worker.
FREQUENT_BYTES = 32 << 20
_ENTRY = 12  # beside the ids: a hash and a place
#: Words that a task counts, or remembers, before it hands them on or forgets them.
_COUNTED = 100_000
#: Scripts whose plain letters the splitting treats as this module's patterns do; each letter is tried.
_SCRIPTS = range(0x80, 0x600)
#: Rows of texts that are handled at once; what is made of them stays small beside a worker's memory.
_ROWS = 250


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)}


_LETTERS = byte_letters()
#: Marks that end a word and begin no contraction.
_MARKS = frozenset(".,;:!?")


class WordEncoder:
    """Splits texts into words and encodes words, by one file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        plain = ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} holds no BPE model with word ends alone")
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.ends, self.vocab = model["end_of_word_suffix"], model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens with conditions")
        # Longest first: of tokens that begin at the same place the longest counts.
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pieces = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        #: How ids travel, and what marks a gap among them.
        self.kind = np.dtype("<u2" if len(self.pieces) < 0xFFFF else "<u4")
        self.gap = np.array(-1).astype(self.kind).tobytes()
        self.pattern = self._own_pattern(spec)
        self.plain = re.compile(f"[ -~{re.escape(''.join(self._plain_letters()))}]*").fullmatch

    def _own_pattern(self, spec: dict) -> regex.Pattern | None:
        """The pattern that cuts lower-cased plain letters like the file's splitting, where that is one pattern whose matches are kept."""
        first = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        alone = first.get("type") == "Split" and first["invert"] and first["behavior"] == "Removed"
        return regex.compile(first["pattern"]["Regex"]) if alone and kinds == ["NFC", "Replace", "Lowercase"] else None

    def _plain_letters(self) -> list[str]:
        """Letters that stay one letter in normal form, whatever stands beside them, and in lower case."""
        kept = []
        for c in map(chr, _SCRIPTS):
            low = c.lower()
            single = unicodedata.category(c)[0] == "L" and len(low) == 1 and c != "Σ" and not unicodedata.combining(c)
            if single and self.normalise(c) == low and len(self.split(f"a{low}b")) == 1:
                kept.append(c)
        return kept

    # Texts to words.

    def blank_words(self, text: str | None) -> list[str]:
        """A text cut at its blanks; no word or added token reaches over one."""
        if not text:
            return []
        # str.split() cuts at four control characters more.
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return [w for w in BLANKS.split(text) if w] if odd else text.split()

    def words(self, blank_word: str) -> list[str]:
        """The words of a text without blanks, as letters for bytes; an added token is a word of its own."""
        if blank_word.isascii() and self.pattern is not None:
            # Most words are letters alone, or letters before one mark.
            if blank_word.isalpha():
                return [blank_word.lower()]
            if blank_word[:-1].isalpha() and blank_word[-1] in _MARKS:
                return [blank_word[:-1].lower(), blank_word[-1]]
        if "<" not in blank_word or not self.special_pattern.search(blank_word):
            return self._plain(blank_word)
        out, at = [], 0
        for m in self.special_pattern.finditer(blank_word):
            out += [*self._plain(blank_word[at : m.start()]), m.group()]
            at = m.end()
        return out + self._plain(blank_word[at:])

    def _plain(self, part: str) -> list[str]:
        if self.pattern is None or not self.plain(part):
            return [w for w, _ in self.split(self.normalise(part))]
        words = self.pattern.findall(part.lower())
        return words if part.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in words]

    # Words to ids.

    def ids(self, word: str) -> np.ndarray:
        """Ids of one word."""
        if word in self.special:
            return np.array([self.special[word]], self.kind)
        return np.array([self.vocab[p] for p in self.merged(word)], self.kind)

    def merged(self, word: str) -> list[str]:
        """Merge the neighbours of lowest rank, the leftmost first, until none merges."""
        part = [*word[:-1], word[-1] + self.ends]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        get = self.ranks.get
        heap = [(rank, i) for i, pair in enumerate(zip(part, part[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if part[i] else len(part)
            if j == len(part) or get((part[i], part[j])) != rank:
                continue  # one of the two was merged since
            part[i], part[j] = part[i] + part[j], ""
            after[i] = k = after[j]
            if k < len(part):
                before[k] = i
                if (rank := get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0 and (rank := get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (rank, h))
        return [p for p in part if p]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; the file lies on every node."""
    return WordEncoder(path)


def word_table(texts: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Each distinct word of all texts once: word, n (occurrences), ids (packed as the encoder's ``kind``), h (hash), twice (another word has it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, blank = encoder(path), Counter(), Counter()

        def cut() -> None:
            for blank_word, n in blank.items():
                for word in own.words(blank_word):
                    found[word] += n
            blank.clear()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                for text in batch.column(0).slice(k, _ROWS).to_pylist():
                    blank.update(own.blank_words(text))
                if len(blank) >= _COUNTED:
                    cut()
                if len(found) >= _COUNTED:
                    yield hand_on()
        cut()
        yield hand_on()

    @F.pandas_udf("binary")
    def encode(words: pd.Series) -> pd.Series:
        own = encoder(path)
        return pd.Series([own.ids(w).tobytes() for w in words], dtype=object)

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    # Dealt by the hash, so that words which share one meet without another shuffle.
    dealt = counted.withColumn("h", F.xxhash64("word")).repartition("h")
    summed = dealt.groupBy("h", "word").agg(F.sum("n").alias("n"))
    alone = summed.withColumn("twice", F.count("*").over(Window.partitionBy("h")) > 1)
    return alone.select("word", "n", encode("word").alias("ids"), "h", "twice")


class Frequent:
    """Ids of words by the hash of the word."""

    def __init__(self, hashes: np.ndarray, ids: list[bytes], alone: bool = False):
        #: Whether a word that is not here occurs once.
        self.alone = alone
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.blob = b"".join([ids[i] for i in order])
        self.ends = np.cumsum([len(ids[i]) for i in order], dtype=np.int64).astype(np.uint32)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word, None where it is not in the table."""
        if not len(self.hashes):
            return [None] * len(words)
        asked = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        there, ends = self.hashes[at] == asked, self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        return [self.blob[a:b] if known else None for known, a, b in zip(there.tolist(), starts.tolist(), ends.tolist())]


def frequent_words(words: DataFrame, most_bytes: int = FREQUENT_BYTES) -> tuple[Frequent, DataFrame]:
    """The most frequent words within ``most_bytes``, and the table of all other ones.

    Classes of counts, a power of two each, enter whole as long as they fit.
    """
    bits = F.length(F.bin("n"))
    classes = words.groupBy(bits.alias("bits")).agg(F.sum(F.octet_length("ids") + F.lit(_ENTRY)).alias("bytes")).orderBy(F.desc("bits")).collect()  # at most 63
    least, room = 1 << 62, most_bytes
    for r in classes:
        room -= r.bytes
        if room < 0:
            break
        least = 1 << (r.bits - 1)
    known = (F.col("n") >= least) & ~F.col("twice")
    table = words.where(known).select("h", "ids").toArrow()  # most_bytes at most
    others = words.where(~known)
    alone = others.where("n > 1").isEmpty()
    frequent = Frequent(table.column("h").to_numpy(), table.column("ids").to_pylist(), alone)
    return frequent, others.select("word", "ids")


class Filler:
    """Texts to ids by the table of frequent words, with marks and words for gaps."""

    def __init__(self, path: str, table: Frequent):
        self.own, self.table = encoder(path), table
        self.packed: dict[str, bytes] = {}  # ids of a text without blanks
        self.older: dict[str, bytes] = {}
        self.missing: dict[str, list[str]] = {}  # the words in its gaps

    def read(self, texts: pa.Array) -> list[list[str]]:
        """The blank words of some texts, each of which is then known."""
        words = [self.own.blank_words(t) for t in texts.to_pylist()]
        asked = set().union(*words)
        if len(self.packed) > _COUNTED:  # what is still asked for comes back from the older half
            self.packed, self.older = {}, self.packed
            self.missing = {b: w for b, w in self.missing.items() if b in self.older}
        asked.difference_update(self.packed)
        for b in asked & self.older.keys():
            self.packed[b] = self.older[b]
        self._learn(asked.difference(self.packed))
        return words

    def _learn(self, blank_words: set[str]) -> None:
        own = self.own
        cut = [(b, own.words(b)) for b in blank_words]
        new = list({w for _, words in cut for w in words})
        known = dict(zip(new, self.table.of(new)))
        if self.table.alone:
            known |= {w: own.ids(w).tobytes() for w in new if known[w] is None}
        for b, words in cut:
            ids = [known[w] for w in words]
            if None in ids:
                self.missing[b] = [w for w, i in zip(words, ids) if i is None]
                ids = [own.gap if i is None else i for i in ids]
            self.packed[b] = ids[0] if len(ids) == 1 else b"".join(ids)

    def ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.packed.__getitem__, words))

    def gaps(self, words: list[str]) -> list[str]:
        missing = self.missing
        return [] if missing.keys().isdisjoint(words) else [w for b in words if b in missing for w in missing[b]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _open_words(path: str, frequent) -> callable:
    """Rows of ``key`` and ``text`` to the words in the gaps of each text that has some."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(path, frequent.value)
        for cut in _slices(batches):
            gaps = [filler.gaps(words) for words in filler.read(cut.column("text"))]
            keys = cut.column("key").filter(pa.array([bool(g) for g in gaps], pa.bool_()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([g for g in gaps if g], pa.list_(pa.string()))], ["key", "gaps"])

    return find


def _gapped(path: str, frequent) -> callable:
    """Rows of ``row``, ``key`` and ``text`` to ``row``, ``key`` and compressed ids with a mark at each gap."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, pack = Filler(path, frequent.value), zstandard.ZstdCompressor(level=3).compress
        for cut in _slices(batches):
            ids = [pack(filler.ids(words)) for words in filler.read(cut.column("text"))]
            yield pa.RecordBatch.from_arrays([cut.column("row"), cut.column("key"), pa.array(ids, pa.binary())], ["row", "key", "ids"])

    return fill


def _finished(own: WordEncoder, path: str, rows: pa.Array, ids: list[np.ndarray], back: bool) -> pa.RecordBatch:
    """Rows with their ids, four bytes each, and with the texts that they decode to where ``back`` asks for them."""
    packed = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
    texts = texts_of(packed, path).cast(pa.string()) if back else pa.nulls(len(ids), pa.string())
    return pa.RecordBatch.from_arrays([rows, packed, texts], ["row", "ids", "text"])


def _whole(path: str, frequent, back: bool) -> callable:
    """Rows of ``row`` and ``text`` to finished rows, where no text has gaps."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(path, frequent.value)
        for cut in _slices(batches):
            ids = [np.frombuffer(filler.ids(words), filler.own.kind) for words in filler.read(cut.column("text"))]
            yield _finished(filler.own, path, cut.column("row"), ids, back)

    return fill


def _filled(path: str, back: bool) -> callable:
    """Rows with compressed ids and what fills their gaps to finished rows."""
    unpack = zstandard.decompress

    def spliced(ids: bytes, fills: list[bytes] | None, own: WordEncoder) -> np.ndarray:
        found = np.frombuffer(unpack(ids), own.kind)
        if not fills:
            return found
        at = np.flatnonzero(found == np.frombuffer(own.gap, own.kind)[0])
        # Each mark becomes as many places as its word has ids.
        counts, marks = np.ones(len(found), np.int64), np.zeros(len(found), bool)
        counts[at], marks[at] = [len(f) // own.kind.itemsize for f in fills], True
        found, places = np.repeat(found, counts), np.repeat(marks, counts)
        found[places] = np.frombuffer(b"".join(fills), own.kind)
        return found

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for cut in _slices(batches):
            ids = [spliced(i, f, own) for i, f in zip(cut.column("ids").to_pylist(), cut.column("fills").to_pylist())]
            yield _finished(own, path, cut.column("row"), ids, back)

    return fill


def encode_texts(
    texts: DataFrame, path: str, text_col: str = "text", out: str = "ids", back: str | None = None, most_bytes: int = FREQUENT_BYTES,
) -> DataFrame:
    """Rows of ``texts``, without ``text_col``, with the ids of each whole text in ``out``.

    Ids come packed, as one binary value of little-endian unsigned 32-bit integers;
    ``unpacked`` makes an array of them.  ``back`` names a column for the text that the
    ids decode to.
    """
    spark, kept = texts.sparkSession, [c for c in texts.columns if c not in (text_col, out, back)]
    words = stored(word_table(texts, path, text_col), "words")
    known, others = frequent_words(words, most_bytes)
    # A struct without fields cannot be written, so the row holds one more.
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = texts.select(row, F.col(f"`{text_col}`").alias("text"))
    field, binary, table = rows.schema["row"], T.BinaryType(), spark.sparkContext.broadcast(known)
    finished = T.StructType([field, T.StructField("ids", binary), T.StructField("text", T.StringType())])
    if known.alone:
        done = rows.mapInArrow(_whole(path, table, bool(back)), finished)
    else:
        rows = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
        missing = rows.select("key", "text").mapInArrow(_open_words(path, table), "key binary, gaps array<string>")
        missing = missing.select("key", F.posexplode("gaps").alias("gap", "word"))
        # One group is one text; equal texts have equal gaps.
        fills = missing.join(others, "word").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("gap", "ids"))).alias("fills"))
        fills = stored(fills.select("key", F.transform("fills", lambda x: x["ids"]).alias("fills")), "fills")
        gapped = rows.mapInArrow(_gapped(path, table), T.StructType([field, T.StructField("key", binary), T.StructField("ids", binary)]))
        done = gapped.join(fills, "key", "left").select("row", "ids", "fills").mapInArrow(_filled(path, bool(back)), finished)
    extra = [F.col("text").alias(back)] if back else []
    return done.select(*[F.col("row")[c].alias(c) for c in kept], F.col("ids").alias(out), *extra)


def unpacked(ids: Column) -> Column:
    """Packed ids as array<int>; empty for null."""

    @F.arrow_udf("array<int>")
    def unpack(rows: pa.Array) -> pa.Array:
        return _lists(rows)

    return unpack(ids)


def _lists(rows: pa.Array) -> pa.Array:
    data = [r or b"" for r in rows.to_pylist()]
    offsets = np.cumsum([0, *[len(d) // 4 for d in data]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32)))


def texts_of(rows: pa.Array, path: str) -> pa.Array:
    """The texts of packed ids: each id joined with its piece of the vocabulary, a blank between."""
    lists, pieces = _lists(rows), pa.array(encoder(path).pieces, pa.large_string())
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pieces.take(lists.values)), pa.scalar(" ", pa.large_string()))


def _sliced(rows: pa.Array) -> list[pa.Array]:
    return [rows.slice(k, _ROWS) for k in range(0, len(rows), _ROWS)] or [rows]


def decoded(ids: Column, path: str) -> Column:
    """The text of each row of packed ids; empty for null."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return pa.concat_arrays([texts_of(some, path).cast(pa.string()) for some in _sliced(rows)])

    return decode(ids)


@query("op11_distinct_words")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as a count and digests of the ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = encode_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, back="back")
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("back").cast("binary"), 256).alias("decoded_sha256"),
    )
