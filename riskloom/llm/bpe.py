"""BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

The frequent words of all documents are encoded once, compiled into a minimal
acyclic transducer with their ids as output (``transducer``), sent to the
executors as a file and memory-mapped there. Words that are not in it are
merged exactly, by the tokenizer's own merge ranks.

Reads tokenizer files of the ``tokenizers`` library whose model is BPE over a
regular-expression split with byte-level letters and a word-end suffix.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.store import dropped, stored
from riskloom.llm.transducer import Lexicon, compile_sorted
from riskloom.session import ship_package

LEXICON_WORDS = 200_000
COUNT_BINS = 100_000
CHUNK = 1 << 20        # characters whose words are looked up together
WORDS_HELD = 300_000   # words a task keeps before it hands on their counts
FRAME_WORDS = 20_000   # words a frame of counts holds
# characters on which every Unicode version agrees: NFC leaves them alone, classes are settled
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ]*")
# the letters and numbers among them, after lower-casing (fixed values)
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """A tokenizer file's words, merges and tokens; encodes words exactly."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = re.compile(pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = None

    def __reduce__(self):
        return Tokenizer, (self.text,)

    def words(self, text: str) -> list[str]:
        """The words of a text in order, special tokens among them."""
        if self.split is None or "<|" not in text and not self.split.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        if self.library is None:
            import tokenizers
            self.library = tokenizers.Tokenizer.from_str(self.text)
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes[c] for c in piece).decode()
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the merge of lowest rank first, of equal ones the leftmost."""
        if word in self.special:
            return [self.special[word]]
        letters = [self.letters[b] for b in word.encode()]
        if not letters:
            return []
        letters[-1] += self.suffix
        ids = [self.vocab[c] for c in letters if c in self.vocab]
        if len(ids) > 48:
            return self._merge_long(ids)
        none = len(self.merged)
        ranks = [self.merges.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i:i + 2] = [self.merged[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.merges.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = self.merges.get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merged[self.merges[pair]], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.merges:
                    p = (ids[a], ids[b])
                    heapq.heappush(heap, (self.merges[p], a, p))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        """The tokens of the ids, special ones included, joined by a space (the file names no decoder)."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def load(path: str) -> Tokenizer:
    """Read a tokenizer file on the driver."""
    with open(path, encoding="utf-8") as f:
        return Tokenizer(f.read())


def _count_words(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, count = sent.value, Counter()

        def frames():
            while count:   # in parts, so that words and their columns are not held twice
                part = [count.popitem() for _ in range(min(FRAME_WORDS, len(count)))]
                yield pd.DataFrame(part, columns=["word", "n"])

        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    count.update(tok.words(text))
                if len(count) > WORDS_HELD:
                    yield from frames()
        yield from frames()
    return run


def _merge_words(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"].str.encode("utf-8"), "ids": pdf["word"].map(sent.value.merge)})
    return run


def build_lexicon(docs: DataFrame, sent, size: int = LEXICON_WORDS) -> bytes:
    """Transducer of the most frequent words of all documents: all with a count that at most ``size`` words reach."""
    counts = stored(docs.select("text").mapInPandas(_count_words(sent), "word string, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the smallest count that at most ``size`` words reach; high counts share a bin
    bins = counts.groupBy(F.least("n", F.lit(COUNT_BINS)).alias("n")).agg(F.count("*").alias("words"))
    least, held = COUNT_BINS + 1, 0
    for r in sorted(bins.collect(), key=lambda r: -r["n"]):
        held += r["words"]
        if held > size:
            break
        least = r["n"]
    # merged by tasks; the driver gets words and ids as Arrow columns, not as a row object for each word
    top = (counts.where((F.col("n") >= least) & (F.col("word") != "")).select("word")
           .mapInPandas(_merge_words(sent), "word binary, ids array<int>").toArrow().sort_by("word").combine_chunks())
    dropped(counts)
    ids = pc.list_flatten(top["ids"]).to_numpy()
    return compile_sorted(top["word"].to_pylist(), np.cumsum([0, *pc.list_value_length(top["ids"]).to_numpy()]), ids)


def _send_file(spark, block: bytes) -> str:
    """Give every executor the block as a file; returns its name."""
    folder = tempfile.mkdtemp(prefix="lexicon-", dir=SparkFiles.getRootDirectory())
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:16]}-{os.path.basename(folder)}.bin"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(block)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


class _Coder:
    """Ids and decoded text of words: transducer first, exact merges for the rest.

    Remembers words of the transducer between the chunks of a task; the others
    are rare in the whole corpus and are forgotten with their chunk.
    """

    def __init__(self, tok: Tokenizer, lexicon: Lexicon):
        self.tok, self.lexicon = tok, lexicon
        self.ids: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        self.rare: list[str] = []

    def learn(self, words: set[str]) -> None:
        for w in self.rare:
            del self.ids[w], self.plain[w]
        self.rare = []
        new = [w for w in words if w not in self.ids]
        for w, n in zip(new, self.lexicon.numbers([w.encode() for w in new]).tolist()):
            if n < 0:
                self.rare.append(w)
            ids = self.lexicon.sequence(n) if n >= 0 else self.tok.merge(w)
            self.ids[w] = " ".join(map(str, ids))
            self.plain[w] = self.tok.decode(ids)


def _chunks(texts) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for b, t in enumerate(texts):
        held += len(t or "")
        if held > CHUNK:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encode(sent, name: str, with_ids: bool, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = sent.value
        coder = _Coder(tok, Lexicon(np.memmap(SparkFiles.get(name), np.int64, "r")))
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in _chunks(texts):
                split = [tok.words(t) if t else [] for t in texts[a:b]]
                coder.learn(set().union(*split))
                shown, plain = coder.ids.__getitem__, coder.plain.__getitem__
                rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
                for ws in split:
                    line = " ".join(map(shown, ws))
                    rows["n_tokens"].append(line.count(" ") + 1 if line else 0)
                    rows["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
                    rows["decoded_sha256"].append(
                        hashlib.sha256(" ".join(map(plain, ws)).encode()).hexdigest())
                    if with_ids:
                        rows["ids"].append(np.fromstring(line, np.int32, sep=" ") if line else np.zeros(0, np.int32))
                if not with_ids:
                    del rows["ids"]
                yield pdf.iloc[a:b][keep].reset_index(drop=True).assign(**rows)
    return run


def encode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS,
           with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256[, ids].

    ids are those of the tokenizers library without special tokens added;
    special tokens that stand in a text are recognised. ``ids_sha256`` is the
    digest of the decimal ids joined by spaces, ``decoded_sha256`` that of the
    decoded text. Defined cases: a null or empty text has no tokens (digests of
    the empty string); rows that repeat a doc_id are encoded each; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(load(tokenizer_path))
    name = _send_file(spark, build_lexicon(docs, sent, lexicon_words))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInPandas(_encode(sent, name, with_ids, ["doc_id"]), schema)


def decode(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add ``decoded``: the text of column ``ids`` (null: null)."""
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(load(tokenizer_path))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda v: None if v is None else sent.value.decode(v))

    return rows.withColumn("decoded", text_of("ids"))
