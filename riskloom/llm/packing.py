"""Packing documents into sequences of a fixed length: minimum bin slack over remaining lengths.

Documents become token ids. Every whole window of ``size`` ids is a sequence of
its own; what remains of a document is a rest of 1 to size - 1 ids. All that
matters of the rests is how many there are of each length, at most size - 1
counts at any input size. On those counts the driver plans: the longest
remaining length opens a window, and a bitset subset-sum program over the
lengths still there picks the multiset that fills the rest of the window
closest; the counts it took are backtracked through the bitsets. The pattern is
used as often as the counts allow, which exhausts one of its lengths, so there
are few patterns. Where no multiset fills the window, a rest of the most
numerous longer length is cut to fill it, and its remainder goes back to the
counts. The last window, if not
full, is dealt to sequences whose lengths are powers of two.

Rests of one length are interchangeable, so the plan only names their ranks:
of length l, ranks a to b go to the windows of pattern p. Each task numbers its
rests by length while it tokenizes; with the counts of the tasks before it that
is the rank among all. No text or id moves for that: rows keep their place, and
only the ids of rests that are cut are read again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.bpe import byte_letters
from riskloom.llm.store import dropped, stored
from riskloom.operators.joins import join_bounded
from riskloom.session import ship_package

SIZE = 1024
END = 0
WORDS_HELD = 400_000   # pieces whose ids a worker remembers
CHUNK = 1 << 20        # characters of a text that are split at once
RANK_BITS = 48
# Characters that every Unicode version classes alike, for which the pattern below splits as the byte-level one does
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞₠-₿]*")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
# fixed value: the byte-level vocabulary's split pattern, with its classes of letters and numbers spelt out (words first:
# no two of the first three alternatives begin alike)
_SPLIT = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
# before a space between two letters a piece always ends
_SAFE = re.compile("(?<=[a-zA-Z])(?= [a-zA-Z])")


def byte_ranks(content: str) -> dict[bytes, int] | None:
    """Every token's bytes and id, if ids alone say how pieces are merged; else None.

    Merging the neighbours whose union has the smallest id gives what the
    ordered merge rules give, if each token has one rule, later rules make
    larger ids, a rule's parts come before it, and each token's own letters
    merge into that token. For then, where two neighbours make a known token,
    nothing was merged across their edges, so they are what that token's own
    letters come to before the last merge: the two parts of its rule.
    """
    spec = json.loads(content)["model"]
    odd = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")
    if spec.get("type") != "BPE" or any(spec.get(k) for k in odd):
        return None
    letters = {c: bytes([b]) for b, c in byte_letters().items()}
    vocab, rules = spec["vocab"], {}
    if not all(c in vocab for c in letters):
        return None
    seen, last = set(letters), max(vocab[c] for c in letters)
    for rule in spec["merges"]:
        a, b = rule.split(" ") if isinstance(rule, str) else rule
        if a not in seen or b not in seen or a + b in seen or vocab.get(a + b, -1) <= last:
            return None
        last = rules[a, b] = vocab[a + b]
        seen.add(a + b)
        parts = list(a + b)
        while len(parts) > 1:
            least, i = min((rules.get((x, y), 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if least == 1 << 60:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return {b"".join(map(letters.__getitem__, t)): vocab[t] for t in seen}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens added.

    Plain texts are split here and each different piece is merged once, by
    ``ranks`` if there are any; other texts, and those that hold a special
    token's string, go to the library whole (long ones in parts that end where
    a piece does).
    """

    def __init__(self, content: str, ranks: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(content)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype(np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # the split is known only of the plain byte-level kind
        pre = str(self.tok.pre_tokenizer)
        self.split = self.tok.normalizer is None and pre.startswith("ByteLevel(") and \
            "add_prefix_space=False" in pre and "use_regex=True" in pre
        self.known: dict[str, bytes] = {}
        self.merge = None
        if ranks:
            from tiktoken import Encoding
            self.merge = Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.kind.char, e.ids).tobytes() for e in found]

    def _parts(self, text: str) -> Iterator[str]:
        a = 0
        while self.split and len(text) - a > CHUNK:
            m = _SAFE.search(text, a + CHUNK)
            if not m:
                break
            yield text[a:m.start()]
            a = m.start()
        yield text[a:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as numbers of ``kind``."""
        split: list[list[list[str] | str]] = []
        pieces: set[str] = set()
        for text in texts:
            if self.special is not None and self.special.search(text):
                split.append([text])
                continue
            split.append([_SPLIT.findall(p) if self.split and _PLAIN.fullmatch(p) else p for p in self._parts(text)])
            for p in split[-1]:
                if not isinstance(p, str):
                    pieces.update(p)
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        new = list(pieces.difference(self.known))
        kind = self.kind.char
        self.known.update(zip(new, (array(kind, self.merge(w)).tobytes() for w in new) if self.merge else self._library(new)))
        known = self.known.__getitem__
        return [b"".join(self._library([p])[0] if isinstance(p, str) else b"".join(map(known, p)) for p in parts)
                for parts in split]


_encoders: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One for all tasks of a worker, which uses one core: the library's own threads would only wait."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    content, ranks = sent.value
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content, ranks)
    return _encoders[key]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoded(enc: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """The texts' ids in order, about CHUNK characters at a time."""
    some, held = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        held += len(some[-1])
        if held > CHUNK:
            yield from enc.encode(some)
            some, held = [], 0
    yield from enc.encode(some)


def _tokenized(sent, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent)
        task, row, windows = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(size, np.int64)
        last = np.array([end], enc.kind).tobytes()
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, raw in zip(b.column("doc_id").to_pylist(), _encoded(enc, b.column("text"))):
                ids = np.frombuffer(raw + last, enc.kind)
                whole, rest = divmod(len(ids), size)
                tail = ids[whole * size:]
                out.append((i, len(ids), [_crc(ids[k * size:(k + 1) * size]) for k in range(whole)], windows, rest,
                            int(seen[rest]), _crc(tail), tail.tobytes(), task, row))
                seen[rest] += 1
                windows += whole
                row += 1
                held += len(tail) + whole
                if held > 1 << 21:
                    yield _token_rows(out)
                    out, held = [], 0
            if out:
                yield _token_rows(out)
    return run


_TOKENS = ("doc_id long, n long, crcs array<long>, windows long, rest int, nth long, crc long, ids binary, "
           "task int, row long")


def _token_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(),
             pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[f.split()[0] for f in _TOKENS.split(", ")])


# --- the plan --------------------------------------------------------------------

def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` from below.

    A bitset (one whole number; bit s says that sum s can be met) grows by one
    length at a time, longest first, and stops when ``room`` is met. Going back
    through the bitsets tells how many of each length the best sum took.
    """
    mask, bits = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int]] = []
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        trail.append((length, bits))
        left, step = min(int(counts[length]), room // length), 1
        while left:  # 1, 2, 4, ... and the rest make every number up to the count
            step = min(step, left)
            bits |= (bits << (length * step)) & mask
            left -= step
            step *= 2
        if bits >> room & 1:
            break
    best, taken = bits.bit_length() - 1, {}
    for length, before in reversed(trail):
        k = 0
        while not before >> best & 1:
            best -= length
            k += 1
        if k:
            taken[length] = k
    return taken


class Plan:
    """Segments of ranks for each length: where the rests with those ranks go.

    A segment (length, from rank, take, per window, sequence, offset, next
    length, next rank) puts ``take`` ids of each rest into a sequence: with j
    the rank within the segment, sequence + j // per window, at offset +
    (j % per window) * length. A rest that was cut goes on as one of the next
    length, with rank next rank + j.
    """

    def __init__(self, counts: np.ndarray, size: int = SIZE):
        self.size = size
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.first = np.zeros(size, np.int64)     # next rank to use
        self.ends = self.left.copy()              # next rank to give to a remainder
        self.segments: list[tuple[int, ...]] = []
        self.sequences = 0
        while self.left.any():
            self._window()

    def _take(self, length: int, ranks: int, take: int, per: int, offset: int, sequence: int) -> None:
        rest = length - take
        after = int(self.ends[rest]) if rest else 0
        self.segments.append((length, int(self.first[length]), take, per, sequence, offset, rest, after))
        self.first[length] += ranks
        self.left[length] -= ranks
        if rest:
            self.ends[rest] += ranks
            self.left[rest] += ranks

    def _window(self) -> None:
        longest = int(np.flatnonzero(self.left)[-1])
        self.left[longest] -= 1
        pattern = fullest(self.left, self.size - longest)
        self.left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        slack = self.size - sum(length * k for length, k in pattern.items())
        cut = 0
        if slack:
            spare = self.left.copy()
            for length, k in pattern.items():
                spare[length] -= k
            if not spare[slack + 1:].any():
                self._last(pattern)
                return
            cut = slack + 1 + int(np.argmax(spare[slack + 1:]))  # the most numerous: few patterns
        times = min(int(self.left[length]) // (k + (length == cut)) for length, k in {cut: 0, **pattern}.items() if length)
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            self._take(length, times * k, length, k, offset, self.sequences)
            offset += length * k
        if cut:
            self._take(cut, times, slack, 1, offset, self.sequences)
        self.sequences += times

    def _last(self, pattern: dict[int, int]) -> None:
        """What is left does not fill a window: sequences of falling powers of two.

        A remainder and another rest of its length may change places, which the counts do not see.
        """
        total = sum(length * k for length, k in pattern.items())
        powers = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        edges = list(accumulate(powers))
        at = part = 0
        for length in sorted((x for x, k in pattern.items() for _ in range(k)), reverse=True):
            while length:
                take = min(length, edges[part] - at)
                start = edges[part] - powers[part]
                self._take(length, 1, take, 1, at - start, self.sequences + part)
                at += take
                length -= take
                if at == edges[part]:
                    part += 1
        self.sequences += len(powers)

    def table(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.segments), np.int64).reshape(-1, 8)
        names = ("length", "rank", "take", "per", "sequence", "offset", "rest", "after")
        out = {n: rows[:, i].copy() for i, n in enumerate(names)}
        out["key"] = (out["length"] << RANK_BITS) | out["rank"]
        return out


def placed(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(which rest, ids before the piece, its length, sequence, offset, whether the rest is cut), piece by piece."""
    which, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    cut = np.zeros(len(length), bool)
    while len(which):
        s = np.searchsorted(plan["key"], (length << RANK_BITS) | rank, "right") - 1
        j = rank - plan["rank"][s]
        goes_on = plan["rest"][s] > 0
        yield (which, start, plan["take"][s], plan["sequence"][s] + j // plan["per"][s],
               plan["offset"][s] + j % plan["per"][s] * length, cut | goes_on)
        start = (start + plan["take"][s])[goes_on]
        which, length, rank = which[goes_on], plan["rest"][s][goes_on], (plan["after"][s] + j)[goes_on]
        cut = np.ones(len(which), bool)


def _pieces(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = b.column("rest").to_numpy().astype(np.int64)
            whole = b.column("n").to_numpy() - rest
            for which, start, length, sequence, offset, cut in placed(plan.value, rest, b.column("rank").to_numpy()):
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), pa.array(whole[which] + start), pa.array(length),
                     b.column("crc").take(at), b.column("n").take(at), pa.array(sequence), pa.array(offset),
                     b.column("task").take(at), b.column("row").take(at), pa.array(start), pa.array(cut)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "row",
                           "from", "cut"])
    return run


def _cut_crcs(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = [_crc(np.frombuffer(raw, kind)[a:a + n]) for raw, a, n in zip(
                b.column("ids").to_pylist(), b.column("from").to_pylist(), b.column("length").to_pylist())]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crcs, pa.int64())],
                                             names=[*names, "ids_crc32"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The documents of ``docs`` (doc_id, text) as pieces of sequences of at most ``size`` ids.

    A document is the ids of its text and the id ``end``. Returns for each
    piece: doc_id, start (ids of its document before it), length, ids_crc32
    (unsigned, of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id and offset (its place there). Every id is in exactly one piece.
    Only sequences that hold ``size`` ids or a power of two of them are made,
    so none needs padding.

    Defined cases: a null or empty text is the id ``end`` alone; null and
    repeated doc_ids are documents each, a row at a time; texts of any length
    are encoded whole; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    kind = Encoder(content).kind.str
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(_tokenized(spark.sparkContext.broadcast((content, byte_ranks(content))), size, end), _TOKENS), "tokens")
    # at most ``size`` rows for each task
    counts = rows.groupBy("rest", "task").agg(F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("rest").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    histogram = np.zeros(size, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("count").alias("count")).collect():
        histogram[r["rest"]] = r["count"]
    plan = Plan(histogram, size)
    ranked = join_bounded(rows.where("rest > 0").select("doc_id", "n", "rest", "nth", "crc", "task", "row"),
                          counts.select("rest", "task", before.alias("before")), ["rest", "task"]) \
        .withColumn("rank", F.col("nth") + F.col("before"))
    pieces = stored(ranked.mapInArrow(
        _pieces(spark.sparkContext.broadcast(plan.table())),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "task int, row long, from long, cut boolean"), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = (join_bounded(rows.where("rest > 0").select("task", "row", "ids"),
                        pieces.where("cut").drop("cut", "ids_crc32"), ["task", "row"])
           .mapInArrow(_cut_crcs(kind), "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                        "offset long, ids_crc32 long"))
    # whole windows: numbered within their task, beyond the plan's sequences
    windows = rows.select("doc_id", "n", "task", "windows", F.posexplode("crcs").alias("at", "crc")).select(
        "doc_id", (F.col("at") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        ((F.col("task").cast("long") + 1) * F.lit(1 << 40) + F.col("windows") + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return windows.unionByName(pieces.where("not cut").select(*names)).unionByName(cut.select(*names))
