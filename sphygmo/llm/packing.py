"""Best-fit packing of tokenized documents, improved by swap-based local search."""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphygmo.llm.common import WORD, table, written

#: Ids in a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Pieces that one task packs together.
GROUP = 8192
#: A sequence filled to this share is not opened again by the next level.
FILLED = 0.98
#: Words, and parts of words, whose ids a worker keeps at most; then it starts anew.
KEPT_WORDS, KEPT_PARTS = 1_200_000, 600_000

_WORDS = re.compile(WORD)
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the rest from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


#: The settings of a tokenizer whose words can be encoded one by one, as its file states them.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class WholeIds:
    """Ids of a text by any tokenizer file, encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ids_of(path: str) -> WordIds | WholeIds:
    """The encoder of a tokenizer file: word by word where its settings are known to allow that, else whole texts."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = all(t["content"].startswith("<") and " " not in t["content"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in told.get("added_tokens") or [])
    same = added and told["model"]["type"] == "BPE" and not told.get("truncation") and all(told.get(k) == v for k, v in _BY_WORD.items())
    return WordIds(path) if same else WholeIds(path)


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of white-space separated words, just as the whole text's encoding has them.

    The tokenizer's normalizer and splitter never look across white space, so a text's ids are those of its words in
    turn. Each word is encoded once and kept. Latin-1 words take the library's BPE model directly; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts = self.tokenizer.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        try:
            word.encode("latin-1")
            plain = not re.search("[\x00-\x20\x7f-\xa0<]", word)
        except UnicodeEncodeError:
            plain = False
        if plain:
            out = b"".join([self.part(p) for p in _PIECES.findall(word.lower())])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def part(self, part: str) -> bytes:
        out = self.parts.get(part)
        if out is None:
            if len(self.parts) >= KEPT_PARTS:
                self.parts.clear()
            ids = [t.id for t in self.model.tokenize(part if part.isalpha() and part.isascii() else "".join([_AS_CHAR[b] for b in part.encode()]))]
            out = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def of(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        if re.search("[\x1c-\x1f]", text):  # white space for str.split alone
            return b"".join([self[w] for w in _WORDS.findall(text)])
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END, cut only if above ``capacity``.

    Null or empty text: one piece that holds END alone. Each row of ``docs`` is a document of its own, equal doc_ids
    too. ``ids`` adds the ids themselves. Batches go out as they fill, so a very long text is no more than itself.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.replace(" long", "").replace(" int", "").replace(" array<int>", "").split(", "))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, step, rows = ids_of(tokenizer), np.array([END], "<u4").tobytes(), 4 * capacity, []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = known.of(text.as_py() or "") + end
                for k in range(0, len(data), step):
                    part = data[k : k + step]
                    rows.append((doc.as_py(), k // step, k // 4, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<i4")] * ids))
                if len(rows) >= 2048:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(free, (lengths[k], -1))
        if at == len(free):
            bins.append([k])
            left, b = capacity - lengths[k], len(bins) - 1
        else:
            left, b = free.pop(at)
            bins[b].append(k)
            left -= lengths[k]
        if left:
            insort(free, (left, b))
    return bins


def _choices(items: list[int], lengths: list[int]) -> list[tuple[int, ...]]:
    """None, one or two items of a bin, each combination of lengths once: a bin of n tokens has under sqrt(2 n) lengths."""
    kept: dict[int, list[int]] = {}
    for k in items:
        kept.setdefault(lengths[k], []).append(k)
    firsts = [v[0] for v in kept.values()]
    return [(), *[(k,) for k in firsts], *combinations(firsts, 2), *[tuple(v[:2]) for v in kept.values() if len(v) > 1]]


class _Offers:
    """What bins could give in exchange, as arrays in the order in which they came; a bin's former offers die when its items
    change."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths, self.sets, self.new = lengths, [], 0
        self.size = self.home = self.count = np.zeros(0, np.int64)

    def add(self, bins: dict[int, list[int]]) -> None:
        fresh = [(b, c) for b, items in bins.items() for c in _choices(items, self.lengths)]
        self.sets += [c for _, c in fresh]
        self.size = np.append(self.size, np.array([sum(self.lengths[k] for k in c) for _, c in fresh], np.int64))
        self.home = np.append(self.home, np.array([b for b, _ in fresh], np.int64))
        self.count = np.append(self.count, np.array([len(c) for _, c in fresh], np.int64))

    def drop(self, bins: set[int]) -> None:
        for b in bins:
            self.home[self.home == b] = -1
        if (dead := self.home < 0).sum() * 2 > len(dead):
            self.new -= int(dead[: self.new].sum())
            self.sets = [c for c, d in zip(self.sets, dead.tolist(), strict=True) if not d]
            self.size, self.home, self.count = self.size[~dead], self.home[~dead], self.count[~dead]

    def best(self, low: int, mine: list[int], fill: np.ndarray, capacity: int) -> tuple[int, tuple, int, tuple]:
        """(gain, given, bin, taken) of the exchange that takes most from ``low`` and raises squared fill; gain 0: none."""
        found = (0, (), -1, ())
        full = fill[self.home]
        most = np.where((self.home >= 0) & (self.home != low), capacity - full, -1)
        least = np.maximum(fill[low] - full, 0)
        few = self.count < 2
        for given in _choices(mine, self.lengths)[1:]:
            gain = sum(self.lengths[k] for k in given) - self.size
            fits = (gain <= most) & (gain > least)
            if len(given) == 2:
                fits &= few
            at = np.flatnonzero(fits)
            if len(at):
                k = int(at[gain[at].argmax()])
                if gain[k] > found[0]:
                    found = (int(gain[k]), given, int(self.home[k]), self.sets[k])
        return found

    def woken(self, fill: np.ndarray, capacity: int) -> set[int]:
        """The bins for which an offer that came since the last call makes an exchange."""
        alive = self.home >= 0
        at, self.new = np.flatnonzero(alive[self.new :]) + self.new, len(self.home)
        givers = alive & (self.count > 0)
        size, home, count, own = self.size[givers], self.home[givers], self.count[givers], fill[self.home[givers]]
        hit = np.zeros(len(size), bool)
        for k in at.tolist():
            gain, full = size - self.size[k], fill[self.home[k]]
            hit |= (gain > 0) & (full + gain <= capacity) & (full + gain > own) & (home != self.home[k]) & ((count < 2) | (self.count[k] < 2))
        return set(np.unique(home[hit]).tolist())


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins: the emptiest bin gives an item away, or swaps one of its items for a shorter one or for two that
    are shorter together, or two of its items for one, whenever the other underfull bin has room for the difference.

    Each exchange must raise the sum of squared fills, so the search ends: when no underfull bin has one left, or at the
    least number of bins that the total length allows. A bin that has none is not looked at again until an offer comes up
    that makes one.
    """
    bins = [list(b) for b in bins]
    fill = np.array([sum(lengths[k] for k in b) for b in bins], np.int64)
    least, open_ = -(-sum(lengths) // capacity), sum(1 for b in bins if b)
    if open_ <= least:
        return [b for b in bins if b]
    offers = _Offers(lengths)
    offers.add({b: items for b, items in enumerate(bins) if items and fill[b] < capacity})
    offers.new = len(offers.home)
    queue = [(int(fill[b]), b) for b in range(len(bins)) if bins[b] and fill[b] < capacity]
    heapify(queue)
    waiting = {b for _, b in queue}
    while waiting and open_ > least:
        size, low = heappop(queue)
        if low not in waiting or size != fill[low]:
            continue
        waiting.discard(low)
        touched = set()
        while bins[low]:
            gain, given, b, taken = offers.best(low, bins[low], fill, capacity)
            if not gain:
                break
            bins[low] = [k for k in bins[low] if k not in given] + list(taken)
            bins[b] = [k for k in bins[b] if k not in taken] + list(given)
            fill[low] -= gain
            fill[b] += gain
            touched.add(b)
            offers.drop({low, b})
            offers.add({x: bins[x] for x in (low, b) if bins[x] and fill[x] < capacity})
        if touched:
            open_ -= not bins[low]
            for b in (touched | (offers.woken(fill, capacity) - waiting)) - {low}:
                waiting.discard(b)
                if bins[b] and fill[b] < capacity:
                    waiting.add(b)
                    heappush(queue, (int(fill[b]), b))
    return [b for b in bins if b]


def _pack_group(level: int, last: bool, capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        order = [(name, "ascending") for name in ("length", "doc_id", "piece", "start", "ids_crc32")]
        rows = rows.sort_by(order)
        lengths = rows.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        seq, offset, done = (np.zeros(len(lengths), np.int64) for _ in range(3))
        base = (level << 56) + (int(rows.column("_g")[0].as_py()) << 14)
        for b, items in enumerate(bins):
            at = 0
            for k in sorted(items):
                seq[k], offset[k], at = base + b, at, at + lengths[k]
            done[items] = last or at >= FILLED * capacity
        for name, values in (("sequence_id", seq), ("offset", offset), ("_done", done)):
            rows = rows.append_column(name, pa.array(values))
        return rows.drop_columns(["_g"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of (doc_id, piece, start, length, ids_crc32, ...).

    Rows are dealt by hash to groups of about ``group``, each packed by best fit and local search in one task. The rows
    of sequences that are not full go on to a next level, dealt anew to fewer groups, until one group is left or a level
    neither halves these rows nor saves a sequence a group (a group at its own least number wastes less than one). A
    level that needs more sequences than the one before is not used. Equal lengths and copies are dealt like other rows.
    No rows: no rows. Lengths are 1 to ``capacity``.
    """
    rows = written(items, "pack-pieces")
    whole = rows.filter(F.col("length") == capacity)
    full = F.shiftleft(F.lit(63).cast("long"), 56) + F.monotonically_increasing_id()
    out = whole.withColumn("sequence_id", full).withColumn("offset", F.lit(0).cast("long"))
    rest, names = rows.filter(F.col("length") < capacity), items.columns
    schema = T.StructType([*items.schema.fields, *[T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "_done")]])
    count, level, before, needed = rest.count(), 0, None, 0
    while count:
        groups = max(1, -(-count // group))
        # the row's own number in the written table keeps repeated rows from meeting in one group
        salt = F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
        packed = written(rest.withColumn("_g", salt.cast("long")).groupBy("_g").applyInArrow(_pack_group(level, groups == 1, capacity), schema), f"pack-level{level}")
        # a sequence has one row at offset 0
        made, left, open_ = packed.agg(F.expr("count_if(offset = 0)"), F.expr("count_if(_done = 0)"), F.expr("count_if(_done = 0 AND offset = 0)")).first()
        if before is not None and made > needed:
            out = out.unionByName(before)
            break
        if left > count // 2 and before is not None and needed - made < groups:
            out = out.unionByName(packed.drop("_done"))
            break
        out = out.unionByName(packed.filter("_done = 1").drop("_done"))
        before, needed = packed.filter("_done = 0").drop("_done"), open_
        rest, count, level = before.select(*names), left, level + 1
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """:func:`pack` over :func:`pieces`: where each piece of each document stands in which sequence."""
    return pack(pieces(docs, tokenizer, capacity, ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from :func:`pack_documents` with ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most CAPACITY tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
